"""SQL twins of the adapter views, and the WITH clause that a query needs."""

from __future__ import annotations

import re

_SHIPMENTS = """
    from lineitem join supplier on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey
    join customer on c_custkey = o_custkey"""

_SECOND = "greatest((ts_ms - min(ts_ms) over () + 999) // 1000 - 1, 0)"

VIEWS: dict[str, str] = {
    "fx_components": """
        select r_regionkey as component,
               case when r_regionkey = 0 then 'spout' else 'bolt' end as kind, 5 as parallelism
        from region""",
    "fx_tasks": "select n_regionkey as component, n_nationkey as task_id from nation",
    "fx_edges": """
        select a.r_regionkey as src, b.r_regionkey as dst
        from region a join region b on a.r_regionkey < b.r_regionkey""",
    "fx_traffic": f"""
        select cast(year(o_orderdate) - 1995 as int) as snapshot_id, s_nationkey as source_task_id,
               c_nationkey as destination_task_id, max(o_orderdate) as ts, count(*) as traffic
        {_SHIPMENTS} group by 1, 2, 3""",
    "fx_tuplesize": f"""
        select cast(year(o_orderdate) - 1995 as int) as snapshot_id, s_nationkey as source_task_id,
               c_nationkey as destination_task_id,
               cast(sum(cast(floor(l_extendedprice) as bigint)) as bigint) as tuplesizesum,
               count(*) as tuplesizecount
        {_SHIPMENTS} group by 1, 2, 3""",
    "fx_load": """
        select cast(year(o_orderdate) - 1995 as int) as snapshot_id, c_nationkey as task_id,
               concat('w', cast(c_nationkey % 4 as varchar)) as worker_hostname,
               6700 + c_nationkey % 2 as worker_port, max(o_orderdate) as ts,
               cast(sum(cast(floor(o_totalprice) as bigint)) as bigint) as load
        from orders join customer on c_custkey = o_custkey group by 1, 2, 3, 4""",
    "fx_worker": """
        select cast(year(o_orderdate) - 1995 as int) as snapshot_id,
               concat('w', cast(c_nationkey % 4 as varchar)) as hostname, 6700 as port,
               max(o_orderdate) as ts, cast(count(*) % 101 as int) as cpu_usage
        from orders join customer on c_custkey = o_custkey group by 1, 2""",
    "fx_node": """
        select distinct concat('w', cast(n_nationkey % 4 as varchar)) as hostname,
               2 + n_nationkey % 4 as core_count, cast(2936012800 as bigint) as core_speed
        from nation""",
    "fx_capacity": "select cast(sum(core_count * core_speed) as bigint) as capacity from fx_node",
    "fx_latency": """
        select epoch_us(ts) // 1000000 as ts_ms,
               cast(floor(value * 1000000) as bigint) as latency_ns, event_type as file
        from events""",
    "fx_throughput": """
        select epoch_us(ts) // 1000000 as ts_ms, 1 + user_id % 3 as cnt, event_type as file
        from events""",
    "fx_reports": """
        select event_id as row_id,
               (epoch_us(ts) - 1704067200000000) // 3600000000
               - case when event_id % 7 = 0 then 1 else 0 end as second
        from events""",
    "fx_cpu_samples": """
        select concat('h', cast(user_id % 4 as varchar)) as host, cast(user_id % 2 as int) as core,
               event_id as seq, ts,
               cast(sum(cast(floor(value * 100) as bigint)) over w as bigint) as busy,
               cast(sum(10000 - cast(floor(value) as bigint)) over w as bigint) as idle
        from events
        window w as (partition by user_id % 4, user_id % 2 order by event_id)""",
    "fx_executors": """
        select cast(n_nationkey // 5 as int) as executor,
               concat('c', cast(min(n_nationkey) as varchar)) as component,
               min(n_nationkey) as start_task, max(n_nationkey) as end_task
        from nation group by n_nationkey // 5""",
    "fx_executor_tasks": """
        select executor, component, n_nationkey as task_id from fx_executors
        join nation on n_nationkey between start_task and end_task""",
    "fx_placements": """
        select a.r_regionkey as allocation_id, e.executor,
               concat('w', cast((e.executor * (a.r_regionkey + 1)) % 4 as varchar)) as hostname,
               6700 + (e.executor + a.r_regionkey) % 2 as port
        from region a cross join fx_executors e""",
    "fx_lines": """
        select event_id as row_id,
               case when event_id % 3 = 0
                    then concat(event_type, ',', cast(user_id as varchar), '*', props)
                    when event_id % 3 = 1 then concat(event_type, '#', props)
                    else event_type end as line
        from events""",
    "fx_words": """
        select word, count(*) as n
        from (select unnest(string_split(text, ' ')) as word from documents)
        where word <> '' group by word""",
    # --- results that later queries build on -----------------------------------
    "fx_edge_traffic": """
        select cast(s.snapshot_id as int) as snapshot_id, e.src, e.dst, cast(coalesce(sum(t.traffic), 0) as bigint) as weight
        from fx_edges e
        cross join (select unnest(generate_series((select min(snapshot_id) from fx_traffic),
                                                  (select max(snapshot_id) from fx_traffic)))
                    as snapshot_id) s
        left join (select x.*, a.component as src, b.component as dst from fx_traffic x
                   join fx_tasks a on a.task_id = source_task_id
                   join fx_tasks b on b.task_id = destination_task_id) t
          on t.snapshot_id = s.snapshot_id and t.src = e.src and t.dst = e.dst
        group by 1, 2, 3""",
    "fx_shifted": """
        select * from (select snapshot_id, src, dst,
                              lag(weight) over (partition by src, dst order by snapshot_id) as weight
                       from fx_edge_traffic) where snapshot_id > 0""",
    "fx_alfa": """
        select s.snapshot_id, s.src, s.dst, coalesce(i.stream_in, 0) as stream_in,
               s.weight as stream_out,
               case when c.kind = 'spout' and s.weight <> 0 then 1.0::double
                    else s.weight::double / case when coalesce(i.stream_in, 0) = 0 then 1
                                                 else i.stream_in end end as alfa
        from fx_shifted s
        join fx_components c on c.component = s.src
        left join (select snapshot_id, dst, cast(sum(weight) as bigint) as stream_in
                   from fx_shifted group by 1, 2) i
          on i.snapshot_id = s.snapshot_id and i.dst = s.src""",
    "fx_mean_alfa": "select src, dst, avg(alfa) as alfa from fx_alfa group by 1, 2",
    "fx_stream_in_task": """
        select snapshot_id, destination_task_id as task_id, cast(sum(traffic) as bigint) as traffic_in
        from fx_traffic group by 1, 2""",
    "fx_stream_out_task": """
        select snapshot_id, source_task_id as task_id, cast(sum(traffic) as bigint) as traffic_out
        from fx_traffic group by 1, 2""",
    "fx_task_points": """
        select cast(s.snapshot_id as int) as snapshot_id, t.task_id, t.component,
               coalesce(case when c.kind = 'spout' then o.traffic_out else i.traffic_in end, 0)
                 as traffic,
               coalesce(l.load, 0) as load
        from fx_tasks t join fx_components c on c.component = t.component
        cross join (select unnest(generate_series((select min(snapshot_id) from fx_load),
                                                  (select max(snapshot_id) from fx_load)))
                    as snapshot_id) s
        left join fx_load l on l.task_id = t.task_id and l.snapshot_id = s.snapshot_id
        left join fx_stream_in_task i on i.task_id = t.task_id and i.snapshot_id = s.snapshot_id
        left join fx_stream_out_task o on o.task_id = t.task_id and o.snapshot_id = s.snapshot_id""",
    "fx_worker_in": """
        select l.snapshot_id, worker_hostname as host,
               cast(coalesce(sum(traffic_in), 0) as bigint) as traffic
        from fx_load l left join fx_stream_in_task i
          on i.snapshot_id = l.snapshot_id and i.task_id = l.task_id
        group by 1, 2""",
    "fx_worker_out": """
        select l.snapshot_id, worker_hostname as host,
               cast(coalesce(sum(traffic_out), 0) as bigint) as traffic
        from fx_load l left join fx_stream_out_task o
          on o.snapshot_id = l.snapshot_id and o.task_id = l.task_id
        group by 1, 2""",
    "fx_worker_points": """
        select l.snapshot_id, l.host, coalesce(i.traffic, 0) as traffic_in,
               coalesce(o.traffic, 0) as traffic_out, l.load, coalesce(w.cpu, 0) as cpu
        from (select snapshot_id, worker_hostname as host, cast(sum(load) as bigint) as load
              from fx_load group by 1, 2) l
        left join fx_worker_in i on i.snapshot_id = l.snapshot_id and i.host = l.host
        left join fx_worker_out o on o.snapshot_id = l.snapshot_id and o.host = l.host
        left join (select snapshot_id, hostname as host, arg_max(cpu_usage, ts) as cpu
                   from fx_worker group by 1, 2) w
          on w.snapshot_id = l.snapshot_id and w.host = l.host""",
    # Expands every path, which only an oracle on a small graph may do.
    "fx_paths": """
        select e.src, e.dst, 11740.0::double as amount
        from fx_edges e join fx_components c on c.component = e.src where c.kind = 'spout'
        union all
        select a.src, a.dst, p.amount * a.alfa
        from fx_paths p join fx_mean_alfa a on a.src = p.dst""",
    "fx_latest_weight": """
        select src, dst, weight from fx_edge_traffic
        where snapshot_id = (select max(snapshot_id) from fx_edge_traffic)""",
    "fx_current_paths": """
        select l.src, l.dst, l.weight::double as amount from fx_latest_weight l
        join fx_components c on c.component = l.src where c.kind = 'spout'
        union all
        select a.src, a.dst, p.amount * a.alfa
        from fx_current_paths p join fx_mean_alfa a on a.src = p.dst""",
    "fx_max_traffic": """
        select e.src, e.dst, coalesce(sum(p.amount), 0) as max_traffic
        from fx_edges e left join fx_paths p on p.src = e.src and p.dst = e.dst group by 1, 2""",
    "fx_max_in": "select dst as component, sum(max_traffic) as max_in from fx_max_traffic group by 1",
    "fx_component_train": """
        select p.*,
               p.traffic::double / case when c.kind = 'spout' then 11740.0
                                        when coalesce(m.max_in, 0) = 0 then 1.0
                                        else m.max_in end as norm_traffic,
               p.load::double / (select capacity from fx_capacity) as norm_load
        from fx_task_points p join fx_components c on c.component = p.component
        left join fx_max_in m on m.component = p.component
        where p.snapshot_id > 0""",
    "fx_worker_train": """
        select p.*, traffic_in::double / (select sum(max_in) from fx_max_in) as norm_in,
               traffic_out::double / (select sum(max_in) from fx_max_in) as norm_out,
               load::double / (select capacity from fx_capacity) as norm_load,
               cpu / 100.0::double as norm_cpu
        from fx_worker_points p""",
    "fx_models": """
        select r_regionkey as component, [(((r_regionkey + 1) * (i + 3)) % 7 - 3) / 4.0::double
               for i in range(10)] as w from region""",
    "fx_scored": """
        select p.*,
               tanh(w[4] + w[1] * tanh(w[6] + w[5] * norm_traffic)
                         + w[2] * tanh(w[8] + w[7] * norm_traffic)
                         + w[3] * tanh(w[10] + w[9] * norm_traffic)) as yhat
        from fx_component_train p join fx_models m on m.component = p.component""",
    "fx_executor_load": """
        select e.executor, e.start_task,
               coalesce(arg_max(l.load, (l.ts, -l.task_id)), 0) as load
        from fx_executors e
        left join fx_executor_tasks t on t.executor = e.executor
        left join fx_load l on l.task_id = t.task_id and l.task_id > 0
        group by 1, 2""",
    "fx_executor_pairs": """
        select a.executor as src_executor, b.executor as dst_executor,
               cast(sum(traffic) as bigint) as traffic
        from fx_traffic join fx_executor_tasks a on a.task_id = source_task_id
        join fx_executor_tasks b on b.task_id = destination_task_id group by 1, 2""",
    "fx_executor_traffic": """
        select e.executor, cast(coalesce(sum(x.traffic), 0) as bigint) as traffic
        from fx_executors e
        left join (select src_executor as executor, traffic from fx_executor_pairs
                   union all select dst_executor, traffic from fx_executor_pairs) x
          on x.executor = e.executor group by 1""",
    "fx_placed": """
        select p.allocation_id, x.src_executor, x.dst_executor, x.traffic,
               case when p.hostname <> q.hostname then 'node'
                    when p.port <> q.port then 'slot' else 'local' end as span
        from fx_executor_pairs x join fx_placements p on p.executor = x.src_executor
        join fx_placements q on q.executor = x.dst_executor and q.allocation_id = p.allocation_id
        where x.traffic > 0""",
    "fx_split": """
        select a.allocation_id, cast(coalesce(sum(traffic), 0) as bigint) as total_traffic,
               cast(coalesce(sum(case when span = 'node' then traffic else 0 end), 0) as bigint)
                 as inter_node,
               cast(coalesce(sum(case when span = 'slot' then traffic else 0 end), 0) as bigint)
                 as inter_slot
        from (select distinct allocation_id from fx_placements) a
        left join fx_placed p on p.allocation_id = a.allocation_id group by 1""",
    "fx_node_stats": """
        select allocation_id, avg(share) as mean_load,
               coalesce(stddev_samp(share), 0.0) as stddev_load
        from (select a.allocation_id, n.hostname,
                     coalesce(sum(l.load), 0)::double / max(n.core_count * n.core_speed) as share
              from (select distinct allocation_id from fx_placements) a cross join fx_node n
              left join fx_placements p on p.allocation_id = a.allocation_id
                                       and p.hostname = n.hostname
              left join fx_executor_load l on l.executor = p.executor
              group by 1, 2) group by 1""",
    "fx_scores": """
        select s.*, t.total_traffic, t.inter_node, t.inter_slot,
               sqrt(case when mean_load > 0 then pow(0.5 * stddev_load / mean_load, 2) else 0 end
                    + case when total_traffic > 0
                           then pow(0.5 * (0.5 * inter_node::double / total_traffic
                                           + 0.5 * inter_slot::double / total_traffic), 2)
                           else 0 end) as score
        from fx_node_stats s join fx_split t on t.allocation_id = s.allocation_id""",
    "fx_tenants": """
        select p.allocation_id, concat('t', cast(p.executor % 2 as varchar)) as topology_id,
               p.executor, p.hostname, p.port
        from fx_placements p""",
    "fx_constraints": """
        select u.allocation_id, u.topology_id, u.used_workers,
               least(2, s.n) as required_workers,
               u.used_workers = least(2, s.n)
                 as workers_ok,
               x.exclusive_ok
        from (select allocation_id, topology_id, count(distinct (hostname, port)) as used_workers
              from fx_tenants group by 1, 2) u
        join (select concat('t', cast(executor % 2 as varchar)) as topology_id, count(*) as n
              from fx_executors group by 1) s on s.topology_id = u.topology_id
        join (select allocation_id, max(k) = 1 as exclusive_ok
              from (select allocation_id, hostname, port, count(distinct topology_id) as k
                    from fx_tenants group by 1, 2, 3) group by 1) x
          on x.allocation_id = u.allocation_id""",
    "fx_whatif": """
        select node_count, max(peak_load) as peak, max(peak_load) <= 0.65 as ok
        from (select c.node_count, (e.pos % c.node_count) as node_no,
                     sum(e.load)::double / max(n.speed) as peak_load
              from (select load, row_number() over (order by start_task) - 1 as pos
                    from fx_executor_load) e
              cross join (select unnest(generate_series(1, (select count(*) from fx_node)))
                          as node_count) c
              join (select core_count * core_speed as speed,
                           row_number() over (order by hostname) - 1 as node_no from fx_node) n
                on n.node_no = e.pos % c.node_count
              group by 1, 2) group by 1""",
    # --- series -----------------------------------------------------------------
    "fx_lat_second": f"select *, {_SECOND} as second from fx_latency",
    "fx_thr_second": f"select *, {_SECOND} as second from fx_throughput",
    "fx_seconds": """
        select unnest(generate_series(0, (select max(second) from fx_lat_second))) as second""",
    "fx_latency_series": """
        select s.second, cast(sum(latency_ns // 1000000) // count(l.ts_ms) as bigint) as latency_ms
        from fx_seconds s left join fx_lat_second l on l.second = s.second group by 1""",
    "fx_throughput_series": """
        select s.second, nullif(count(l.ts_ms), 0) as n
        from fx_seconds s left join fx_lat_second l on l.second = s.second group by 1""",
    "fx_merged_series": """
        select s.second, cast(coalesce(sum(cnt), 0) as bigint) as n
        from (select unnest(generate_series(0, (select max(second) from fx_thr_second))) as second) s
        left join fx_thr_second t on t.second = s.second
        where s.second < (select max(second) from fx_thr_second) group by 1""",
    "fx_running": """
        select *, greatest(max(second) over (order by row_id), -1) as current_second
        from fx_reports""",
    "fx_per_second": """
        select current_second as second, count(*) as n from fx_running
        where current_second > -1 and current_second < (select max(second) from fx_reports)
        group by 1""",
    "fx_zipped": """
        select d.second, d.n as data_driver, t.n as spout, l.latency_ms as latency
        from fx_merged_series d left join fx_throughput_series t on t.second = d.second
        left join fx_latency_series l on l.second = d.second""",
    "fx_smooth": """
        select second, data_driver, spout, latency,
               case when second < 10 then data_driver * 3.0::double
                    else avg(data_driver * 3.0::double) over w end as data_driver_avg,
               case when second < 10 then coalesce(spout, 0)::double
                    else avg(coalesce(spout, 0)::double) over w end as spout_avg,
               case when second < 10 then coalesce(latency, 0)::double
                    else avg(coalesce(latency, 0)::double) over w end as latency_avg
        from fx_zipped
        window w as (order by second rows between 9 preceding and current row)""",
    # --- cpu --------------------------------------------------------------------
    "fx_readings": """
        select host as task_id, epoch_us(ts) // 1000000 as ts_ms, min(busy) * 1000 as cpu_ns
        from fx_cpu_samples group by 1, 2""",
    "fx_next_reading": """
        select r.task_id, r.ts_ms, r.cpu_ns, n.ts_ms as next_ms
        from fx_readings r asof left join fx_readings n
          on n.task_id = r.task_id and n.ts_ms >= r.ts_ms + 1000""",
    "fx_accepted": """
        select r.* from fx_next_reading r
        where r.ts_ms = (select min(ts_ms) from fx_readings q where q.task_id = r.task_id)
        union all
        select r.* from fx_accepted a join fx_next_reading r
          on r.task_id = a.task_id and r.ts_ms = a.next_ms""",
    "fx_cycles": """
        select task_id, ts_ms,
               cast(floor((cpu_ns - coalesce(lag(cpu_ns) over (partition by task_id order by ts_ms),
                                             0)) * 2.5::double) as bigint) as cycles
        from fx_accepted""",
    "fx_rolling": """
        select host, seq, cpu_percent,
               cast(sum(cpu_percent) over w // count(*) over w as bigint) as cpu_usage
        from (select host, seq, prev,
                     ((busy * 100000 - prev) * 100) // (10000000000 * 2) as cpu_percent
              from (select host, seq, busy,
                           lag(busy * 100000) over (partition by host order by seq) as prev
                    from fx_cpu_samples) where prev > 0)
        window w as (partition by host order by seq rows between 5 preceding and current row)""",
    "fx_tuples": """
        select ts, user_id % 7 as task_id, event_id % 6 - 1 as source_task_id,
               event_type as stream, props, cast(floor(value) as bigint) as latency_ms
        from events""",
}

_RECURSIVE = {"fx_paths", "fx_current_paths", "fx_accepted"}


def with_views(sql: str) -> str:
    """Prefix the views a query mentions, in dependency order."""
    ordered: list[str] = []

    def visit(text: str, parent: str | None = None) -> None:
        for name in dict.fromkeys(re.findall(r"\bfx_\w+", text)):
            if name in VIEWS and name != parent and name not in ordered:
                visit(VIEWS[name], name)
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    if not ordered:
        return sql
    keyword = "with recursive" if _RECURSIVE & set(ordered) else "with"
    body = ",\n".join(f"{name} as ({VIEWS[name]})" for name in ordered)
    return f"{keyword} {body}\n{sql}"
