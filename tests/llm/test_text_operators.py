"""Quality, toxicity, main text and sampled pieces against hand-made cases and brute force."""

import math
import os
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import corpus

from voxelcohort.llm import line_crf, main_text, piece_sampling, textgrid, toxicity

GOOD = "A quiet line of plain words. It goes on for a while, calmly.\nAnother plain line follows it here."
BAD = "BUY!! NOW!! $$$ %%% ### NOW!! NOW!!\n| x | y | z | 1 | 2 | !!! @@@"


@pytest.fixture(scope="module")
def labelled(spark):
    docs = [(k, f"{GOOD} no {k}" if k % 2 else f"{BAD} no {k}") for k in range(80)]
    labels = [(k, k % 2, 1 - k % 2) for k in range(80)] + [(1, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_words_follow_the_contract():
    texts = ["a\x0bb\tc", None, "", "  x y\n", "é z"]
    got = [[] for _ in texts]
    for begin, _, data, offsets in textgrid.blocks(pa.array(texts), size=3):
        for s, e, r in zip(*textgrid.words(data, offsets)):
            got[begin + r].append(data[s:e].tobytes().decode())
    assert got == [["a", "b", "c"], [], [], ["x", "y"], ["é z"]]


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    emit, turn, row = rng.normal(size=7), rng.normal(size=(2, 2)), np.array([0, 0, 0, 0, 2, 2, 3])
    forward, backward = line_crf.forward_backward(emit, row, turn)
    got = 1 / (1 + np.exp(-(forward + backward)))
    for r in (0, 2, 3):
        at = np.flatnonzero(row == r)
        weights = np.zeros((len(at), 2))
        for path in range(2 ** len(at)):
            s = [(path >> k) & 1 for k in range(len(at))]
            w = math.exp(sum(emit[a] * x for a, x in zip(at, s)) + sum(turn[x, y] for x, y in zip(s, s[1:])))
            weights[np.arange(len(at)), s] += w
        assert np.allclose(got[at], weights[:, 1] / weights.sum(axis=1))


def test_quality_learns_and_handles_odd_rows(spark, labelled):
    docs, labels = labelled
    model = line_crf.fit(docs, labels, F.col("doc_id") < 60)
    scores = {r["doc_id"]: r["score"] for r in line_crf.score(docs, model).collect()}
    assert all((scores[k] >= 0.5) == (k % 2 == 1) for k in range(80))
    odd = corpus.frame(spark)
    out = line_crf.score(odd.withColumn("score", F.lit("old")), model)
    assert out.columns == [*odd.columns, "score"] and out.count() == odd.count()
    assert all(r["score"] == 0 for r in out.filter("trim(coalesce(text, '')) = '' or text = ' \\n\\t '").collect())
    assert line_crf.score(corpus.empty(spark), model).count() == 0
    lines = line_crf.label_lines(docs.limit(1), model).collect()
    assert len(lines) == 2 and all(0 <= r["good"] <= 1 for r in lines)


def test_quality_without_labels_scores_half(spark, labelled):
    docs, labels = labelled
    model = line_crf.fit(docs, labels.filter("false"), F.lit(True))
    assert {round(r["score"], 6) for r in line_crf.score(docs, model).collect()} == {0.5}


def test_toxicity_learns_and_handles_odd_rows(spark, labelled):
    docs, _ = labelled
    rng = np.random.default_rng(1)
    texts = [(k, " ".join(rng.choice(["sun", "tree", "road", "house"], 30)) + (" you id1ot grumblefoo" if k % 3 == 0 else "")) for k in range(600)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(600)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") % 4 != 2)
    held = toxicity.score(docs.filter("doc_id % 4 = 2"), model).collect()
    assert all((r["score"] >= 0.3) == (r["doc_id"] % 3 == 0) for r in held)
    odd = toxicity.score(corpus.frame(spark), model).collect()
    assert len(odd) == len(corpus.rows()) and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.score(corpus.empty(spark), model).count() == 0
    flat = toxicity.fit(docs, labels.filter("toxic = 0"), F.lit(True))
    assert {r["score"] for r in toxicity.score(docs, flat).collect()} == {0.0}


def test_obfuscated_words_meet_their_plain_form():
    def first(text):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        return toxicity.terms(data, np.array([0, len(data)]))[3][0].tolist()

    assert first("1d10t id1ot") == [*first("1d10t"), *first("idiot")] and first("ÉTÉ") == first("été")


@pytest.mark.parametrize(("page", "text"), [
    ("", ""), ("plain", "plain"), ("<script>x", ""), ("<!-- z <p>", ""),
    ("<nav><a>m n o</a></nav><article><h1>T &amp; U</h1><p><b>a<br> b</b>c<p>d&#x41;</article><footer>f g h i j</footer>", "T & U\na bc\ndA"),
    ("<body><div class='menu'><a>x y z</a></div><div id=main-text><p>one two three four five six seven</p><div class=ad>buy it</div><p>eight nine ten eleven</p>"
     "<form>name</form></div><section id='comments'><p>first post</p></section></body>", "one two three four five six seven\neight nine ten eleven"),
])
def test_main_text(page, text):
    weights = {"default": -0.3, "nav": -2, "footer": -2}
    assert main_text.extract(page, weights) == text


POST = "one two three four five six seven eight nine ten eleven twelve"


@pytest.mark.parametrize("extra", [
    "<article class='comment-body'><p>nice post indeed</p></article>", "<aside><article><h3>teaser of another post</h3></article></aside>",
    "<main> </main>", "<article class='comment-body'><p>first</p></article><aside><article>more to read</article></aside>",
])
def test_main_text_needs_no_mark_when_marks_hold_no_content(extra):
    page = f"<body><nav><a>m n o</a></nav><div class='entry-content'><p>{POST}</p></div>{extra}</body>"
    assert main_text.extract(page, {"default": -0.3, "nav": -2}) == POST


@pytest.mark.parametrize(("page", "text"), [
    (f"<div class='layout has-sidebar'><article><p>{POST}</p></article><div class='sidebar'>x y</div></div>", POST),
    (f"<div id='page-with-menu'><div class='menu'><a>x y</a></div><div class='post'><p>{POST}</p></div></div>", POST),
    (f"<div class='modal'><article><h1>T</h1><p>a b</p></article></div><div>{POST}</div>", "T\na b"),
    (f"<div class='overlay'><div><p>{POST}</p></div><div class='site-footer'>x y z</div></div>", POST),
    *[(f"<article><p>a b c</p><section id='{name}'><p>{POST}</p></section><p>d e</p></article>", f"a b c\n{POST}\nd e")
      for name in ("discussion", "related-work", "legal-history", "search-results")],
    (f"<article class='post comments-open has-related'><p>{POST}</p></article>", POST),
    (f"<div class='post'><p>{POST}</p></div><div class='comments-area'><p>{POST} {POST} {POST}</p></div>", POST),
    (f"<div class='post'><p>{POST}</p></div><div class='comment-list'><p>x y z</p></div><div id='footer'><p>x y z</p></div>", POST),
])
def test_main_text_marks_drop_no_part_of_the_article(page, text):
    assert main_text.extract(f"<body>{page}</body>", {"default": -0.3}) == text


LINKS = "".join(f"<li><a href='{k}'>linked words number {k}</a></li>" for k in range(12))
SIDE = "<p>words of side matter that go on and on</p>" * 30


@pytest.mark.parametrize(("page", "text"), [
    (f"<main><h1>Title</h1></main><div class='entry'><p>{POST}</p></div>", f"Title\n{POST}"),
    (f"<h1>Title</h1><span>By A</span><div><p>{POST}</p></div>", f"Title\nBy A\n{POST}"),
    (f"<div class='post'><header><h1>Real title</h1></header><p>{POST}</p></div>", f"Real title\n{POST}"),
    (f"<div><header><h1>Site</h1><nav><a>x</a></nav></header><p>{POST}</p></div>", POST),
    (f"<div><header><h1>Site</h1></header><div><h1>Title</h1><p>{POST}</p></div></div>", f"Title\n{POST}"),
    (f"<div><p>{POST}</p><p><a href='x'>read the whole study here</a></p></div>", f"{POST}\nread the whole study here"),
    # a list of links is bridged where both parts outweigh it
    (f"<div><p>{POST} {POST} {POST}</p><ul>{LINKS}</ul><p>{POST}</p><p>{POST} {POST}</p></div>",
     "\n".join([f"{POST} {POST} {POST}", *[f"linked words number {k}" for k in range(12)], POST, f"{POST} {POST}"])),
    *[(f"<{name}><p>{POST}</p><div id='comments'><p>great post</p></div><div id='sidebar'><p>about us</p></div></{name}>", POST) for name in ("main", "article")],
    (f"<article><p>{POST}</p><div class='share-buttons'>share</div><div class='newsletter-signup'>sign up</div><p class='ad'>buy</p><p>end <span class='ad'>or <span>buy</span></span> here</p></article>",
     f"{POST}\nend here"),
    (f"<article><p class='ad'>buy<p>{POST}<ul><li class='ad'>buy<li>a</ul><p>b</article>", f"{POST}\na\nb"),
    *[(f"<div class='post'><p>{POST}</p></div><div class='{name}'>{SIDE}</div>", POST) for name in ("comments", "sidebar", "related-posts")],
    (f"<div class='entry-content'><p>{POST}</p></div><ol class='comment-list'>" + f"<li><article class='comment-body'>{SIDE}</article></li>" * 3 + "</ol>", POST),
])
def test_main_text_keeps_the_article_and_no_side_matter(page, text):
    assert main_text.extract(f"<body>{page}</body>", {"default": -0.3}) == text


@pytest.mark.parametrize("before", [
    "<svg/>", "<svg class='icon' aria-label='a > b' />", "<math/><svg viewBox='0 0 1 1'/>", "<svg><path/></svg>", "<button-group><i>x</i></button-group>", "<title-bar>x</title-bar>",
    "<object-view>x</object-view>", "<script>var a;</script>", "<button>press</button>",
])
def test_main_text_icons_and_custom_elements_end_where_they_end(before):
    page = f"<body>{before}<article><p>{POST}</p></article><svg><text>x</text></svg></body>"
    assert main_text.extract(page, {"default": -0.3}) == POST


def test_main_text_frames(spark):
    pages = [(k, "u", f"<nav>a b c</nav><article><p>text {k}</p></article><footer>z y x w v</footer>", "x") for k in range(20)] + [(20, None, None, "x"), (20, None, None, "x")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    got = main_text.main_text(frame, main_text.fit(frame)).collect()
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in got) == sorted([*[(k, f"text {k}", len(f"text {k}")) for k in range(20)], (20, "", 0), (20, "", 0)])
    nothing = frame.filter("false")
    assert main_text.main_text(nothing, main_text.fit(nothing)).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    return piece_sampling.load_vocabulary()


def test_sampling_follows_the_path_weights(vocabulary):
    v, word, n = vocabulary, b" hello", 60_000
    pieces = {v.flat[v.begin[k]:v.begin[k + 1]].tobytes(): int(k) for k in v.ids}

    def paths(i):
        if i == len(word):
            yield 0.0, ()
        for j in range(i + 1, len(word) + 1):
            if (k := pieces.get(word[i:j])) is not None:
                for w, rest in paths(j):
                    yield v.weight[k] + w, (k, *rest)

    expected = {p: math.exp(w) for w, p in paths(0)}
    total = sum(expected.values())
    ids, count = piece_sampling.sample_block(v, np.frombuffer(word * n, dtype=np.uint8), np.arange(n + 1) * len(word), np.arange(n), 4)
    got = Counter(tuple(x.tolist()) for x in np.split(ids, np.cumsum(count)[:-1]))
    assert set(got) <= set(expected)
    for path, weight in expected.items():
        share = weight / total
        assert abs(got[path] / n - share) < 5 * math.sqrt(share / n) + 1e-4


def test_pieces_decode_to_the_text_and_do_not_depend_on_partitions(spark, vocabulary):
    docs = corpus.frame(spark)
    once = piece_sampling.encode(docs, vocabulary, F.col("doc_id"))
    again = piece_sampling.encode(docs.repartition(1).orderBy(F.desc("doc_id")), vocabulary, F.col("doc_id"))
    pieces = {r["doc_id"]: r["pieces"] for r in once.collect()}
    assert pieces == {r["doc_id"]: r["pieces"] for r in again.collect()}
    words = spark.createDataFrame([(k, "several wonderful hello worlds " * 20) for k in range(3)], "doc_id long, text string")
    drawn = {(seed, r["doc_id"]): tuple(r["pieces"]) for seed in (0, 1) for r in piece_sampling.encode(words, vocabulary, F.col("doc_id"), seed=seed).collect()}
    assert len(set(drawn.values())) == 6
    decoded = {r["doc_id"]: r["text"] for r in piece_sampling.decode(once, vocabulary).collect()}
    assert decoded == {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    digest = {r["doc_id"]: r for r in piece_sampling.encode_digest(docs, vocabulary, F.col("doc_id")).collect()}
    sha = {r["doc_id"]: r["s"] for r in docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("s")).collect()}
    assert all(digest[k]["n_pieces"] == len(pieces[k]) and digest[k]["text_sha256"] == sha[k] for k in sha)
    assert piece_sampling.encode(corpus.empty(spark), vocabulary, F.col("doc_id")).count() == 0
