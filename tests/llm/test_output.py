"""Token blocks, page texts and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from flowgauge.llm import html, queries, tokens, toxicity
from flowgauge.llm.chars import letter_table
from flowgauge.runtime import scratch_path
from tests.llm import plain

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 9), st.integers(0, 60_000), st.integers(0, 2**60 - 1)), max_size=700))
def test_words_round_trip(ids):
    ids = np.array(ids, dtype=np.uint64)
    assert (tokens.unpack(tokens.pack(ids), len(ids)) == ids).all()


@pytest.mark.parametrize("n", [1, 2, 3, 59, 60, 61, 119, 120, 121, 239, 240, 241, 1000])
def test_runs_of_every_width_round_trip(n):
    for width in range(33):
        ids = np.full(n, (1 << width) - 1, dtype=np.uint64)
        assert (tokens.unpack(tokens.pack(ids), n) == ids).all()
    assert len(tokens.pack(np.zeros(240, dtype=np.uint64))) == 8


def _library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_pieces_give_the_ids_of_whole_texts():
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "the", "Word", "'s", "don't", "12", "é", "ß", ".", ",", "!?", "<|endoftext|>", "　", "日本", "\x1c", "\r\n", "ǆ"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(4000)]
    want = [e.ids for e in _library().encode_batch(texts, add_special_tokens=False)]
    encoder = tokens.PieceEncoder(PATH, remembered=300)
    got = [ids.tolist() for at in range(0, len(texts), 50) for ids in encoder.encode(texts[at : at + 50])]
    assert got == want


def _expected(docs):
    library, start, out = _library(), 0, []
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_written_tokens_read_back(spark):
    docs = [(7, "b a. c"), (3, None), (-2, ""), (None, "null id"), (12, "word " * 60_000), (11, "x\ny"), (5, "<|endoftext|> end")]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, part int")
    assert sorted((tuple(r) for r in tokens.tokenize(df, PATH).collect()), key=repr) == sorted(_expected(docs), key=repr)
    assert tokens.tokenize(df.limit(0), PATH).count() == 0
    folder = scratch_path(spark, "test-tokens")
    tokens.write_tokens(df, PATH, folder)
    library = _library()
    read = tokens.read_documents(spark.read.schema(tokens.BLOCK_SCHEMA).parquet(folder)).collect()
    assert {r["doc_id"]: r["ids"] for r in read} == {i: library.encode(t or "").ids for i, t in docs}


def test_equal_ids_are_all_written(spark):
    df = spark.createDataFrame([(1, "one"), (1, "one"), (1, "two words"), (2, "z")], "doc_id long, text string")
    rows = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in tokens.tokenize(df, PATH).collect())
    assert [r[2] for r in rows] == [1, 1, 1, 2]
    assert all(a[0] + a[1] == b[0] for a, b in zip(rows, rows[1:], strict=False))


def test_tokens_of_the_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in queries.op9_token_output(spark, sf_dir).collect()) == sorted(_expected(docs))


PAGES = [
    ("<html><head><title>T</title></head><body><nav><a href=a>Home</a></nav><article><h1>Big &amp; small</h1><p>One <b>bo</b>ld\n word.<br>Two&nbsp;x</p></article><footer>(c)</footer>", "Big & small One bold word. Two x"),
    ("<body><div class='ad'>Buy now and here</div><main><p>Kept</p><aside>Not this</aside><p>kept too</p><form><label>No</label></form></main>", "Kept kept too"),
    ("<article><p>Text<script>var t='</p>';</script> goes on</p><!-- <p>no</p> --><style>p{}</style><div id=comments><p>A reader wrote this long line of words</p></div><p>end</article>", "Text goes on end"),
    ("<ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul><p>" + "running text " * 30 + "</p><p>" + "more of it " * 30, ("running text " * 30 + "more of it " * 30).strip()),
    ("<article><p>unclosed <b>bold<p>next</article><div class=cookie-banner>We set cookies</div>", "unclosed bold next"),
    # names that tell of something else on the page, or whose noun is no furniture
    ("<article style='overflow:hidden'>kept text</article>", "kept text"), ("<article data-menu='hidden'>kept text</article>", "kept text"),
    ("<main class='with-sidebar'>kept text</main><div class=sidebar>not this</div>", "kept text"),
    ("<div class='content no-sidebar'><p>" + "kept text " * 20 + "</div>", ("kept text " * 20).strip()),
    ("<article class='post has-comments'>kept text</article>", "kept text"), ("<article class='share-price'>kept text</article>", "kept text"),
    ("<section class='rail-travel'><p>" + "kept text " * 20 + "</section>", ("kept text " * 20).strip()), ("<p>Hello world</p>", "Hello world"),
    # furniture stays furniture below
    ("<article>kept</article><div id='comments'><article>reader text</article></div>", "kept"),
    ("<main>kept</main><aside><article>related</article></aside>", "kept"), ("<nav><div class='entry'>menu</div></nav><main>kept</main>", "kept"),
    # without an article words and density of links decide
    ("<div><a href=a>One</a> <a href=b>Two</a></div><div>" + "running text " * 30 + "</div><div><a href=c>next one</a></div>", ("running text " * 30).strip()),
    # a name that takes the whole page is not believed
    ("<div class='widget'><p>" + "running text " * 30 + "</p></div>", ("running text " * 30).strip()),
    ("<p title='a > b'>kept</p><p title='open>also kept</p>", "kept also kept"),
    (None, ""), ("", ""), ("<", ""), ("<p", ""), ("<article>a < b &lt;i&gt; <p hidden>no</p><p>&#233;&eacute;", "a < b <i> éé"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_main_text(page, text):
    assert html.main_text(page, html.train_tree()) == text


@pytest.mark.parametrize(
    "page", ["<script " * 40_000, "<a " * 160_000, "<p>" * 50_000 + "</b>" * 50_000, "<a \"'>" * 50_000, "<!-- " * 50_000, "<div class=x>" * 50_000 + "</div>" * 50_000, "<" * 100_000]
)
def test_time_follows_the_length(page):
    import time

    begun = time.monotonic()
    html.main_text(page + "<p>end", html.train_tree())
    assert time.monotonic() - begun < 10


def test_tree_fits_its_table():
    tree = html.train_tree()
    assert (tree.keep(html.LABELLED[:, :-1]) == html.LABELLED[:, -1].astype(bool)).all()


def test_pages_keep_other_columns(spark):
    df = spark.createDataFrame([(1, None, "u", "x"), (1, PAGES[0][0], "u", "x"), (None, "<p>" * 20_000, None, None)], "page_id long, html string, url string, text string")
    got = html.extract_text(df)
    assert got.columns == ["page_id", "url", "text"]
    assert [r["text"] for r in got.collect()] == ["", PAGES[0][1], ""]
    assert html.extract_text(df.limit(0)).count() == 0


def test_page_query(spark, sf_dir):
    import html as decode
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.op10_html_extraction(spark, sf_dir).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S).group(1)
        inner = re.sub(r"<[^>]*>", " ", re.sub(r"</?(?:b|i|em|a)\b[^>]*>", "", inner))
        assert r["text"] == " ".join(decode.unescape(inner).split()) and r["n_chars"] == len(r["text"])


def test_pipeline_matches_plain(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text").collect()]
    net = toxicity.train_toxicity_model(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    )
    table = letter_table()

    def toxic(text):
        top = net.worst(toxicity.read_words([text], table), 1)[0]
        return net.slope * top + net.offset >= 0

    docs = [d for d in docs if not toxic(d[2])]
    groups = plain.jaccard([(i, t) for i, _, t in docs])
    docs = [d for d in docs if groups[d[0]][1] == d[0]]
    items = [plain.plain_words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    seeds = {tuple(w[k : k + 3]) for w in items for k in range(len(w) - 2)}

    def leaked(text):
        w = plain.plain_words(text)
        if not any(tuple(w[k : k + 3]) in seeds for k in range(len(w) - 2)):
            return False
        return any(plain.alignment(w, item) >= len(item) for item in items)

    docs = [d for d in docs if not leaked(d[2])]
    copies, _, _ = plain.mixed(docs)
    want = _expected([(i, t) for (i, _, t), n in zip(docs, copies, strict=True) for _ in range(n)])
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(tuple(r) for r in got) == Counter(want)


def test_stages_keep_columns_and_take_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], docs.schema)
    for rows in (docs.limit(0), odd):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, sf_dir)
            assert out.columns == docs.columns
            out.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, rows, sf_dir).count() == rows.count()


def test_near_copies_judges_texts_not_ids(spark, sf_dir):
    """A clean text that shares its id with a near copy stays on every run; the copy goes."""
    long = " ".join(f"w{i}" for i in range(300))
    clean = " ".join(f"c{i}" for i in range(300))
    rows = [(1, long), (5, clean), (5, long + " more"), (5, clean), (7, ""), (7, ""), (8, None), (None, long), (None, long)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for parts in (1, 7):
        got = corpus_pipeline.drop_near_copies(spark, docs.repartition(parts), sf_dir)
        assert got.columns == docs.columns
        kept = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in got.collect()))
        assert kept == sorted([(False, 1, long), (False, 5, clean), (False, 7, ""), (False, 8, ""), (True, 0, long), (True, 0, long)])
