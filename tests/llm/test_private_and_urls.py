"""Surrogates and the temporal URL list join; queries and the pipeline as a whole."""

import datetime
import importlib
import os
import re
import sys

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import corpus

from voxelcohort.llm import surrogates, url_lists

TEXT = (
    'Mail ann.lee@corp.example.com or +1 (212) 555-0143, card 4111 1111 1111 1111 from 10.1.2.3, not 1.2.3.4.5 nor 2.0. '
    'token = "0123456789abcdef0123456789abcdef" Mrs. Anna Smith met Mr. John Smith; Frau Анна Орлова: SSN 078-05-1120, DE44 5001 0517 5407 3249 31.'
)


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10


def test_surrogates_keep_type_format_and_reference(spark):
    rows = [(1, TEXT), (2, "again ann.lee@corp.example.com!"), (3, "bob.ray@corp.example.com"), (4, None), (5, ""), (6, "plain"), (1, TEXT)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_text", F.lit(0)).withColumn("n_entities", F.lit("old"))
    out = sorted(((r["doc_id"], r["text"], r["n_entities"]) for r in surrogates.replace(docs, "k").collect()), key=lambda r: r[0])
    assert [r[0] for r in out] == [1, 1, 2, 3, 4, 5, 6] and out[0] == out[1] and out[4:] == [(4, None, 0), (5, "", 0), (6, "plain", 0)]
    new, count = out[0][1], out[0][2]
    assert count == 10 and "not 1.2.3.4.5 nor 2.0." in new
    for gone in ("ann.lee", "555-0143", "4111 1111", "10.1.2.3", "0123456789abcdef", "Anna Smith", "John Smith", "Орлова", "078-05-1120", "5001 0517"):
        assert gone not in new
    assert re.search(r"Mail [a-z]{3}\.[a-z]{3}@[a-z]{4}\.example\.com or \+1 \(\d{3}\) \d{3}-\d{4}, card (\d{4}(?: \d{4}){3}) from 10\.\d+\.\d+\.\d+, ", new)
    assert luhn(re.search(r"card ([\d ]+) from", new)[1].replace(" ", "")) == 0
    female, male = re.search(r"Mrs\. (\S+) \S+ met Mr\. (\S+) ", new).groups()
    assert female in surrogates.NAMES["female", "latin"] and male in surrogates.NAMES["male", "latin"]
    assert re.search(r"Frau (\S+) [А-Яа-яё\-]+:", new)[1] in surrogates.NAMES["female", "cyrillic"]
    mail = re.search(r"\S+@\S+com", new)[0]
    assert out[2][1] == f"again {mail}!" and out[3][1] != mail
    assert surrogates.replace(corpus.empty(spark), "k").count() == 0
    assert sorted(r["text"] for r in surrogates.replace(docs.filter("doc_id = 1"), "other").collect())[0] != new


def test_surrogates_find_each_kind_where_nothing_else_is(spark):
    values = [
        "a.b@corp.example.com", "10.1.2.3", "DE44 5001 0517 5407 3249 31", "4111 1111 1111 1111", "078-05-1120", "+1 (212) 555-0143", "0123456789abcdef0123456789abcdef",
        "Mr. John Smith", "Frau Anna Orlova", '"correcthorsebatterystaple"', "'Correct_Horse-Battery+Staple/='", '"ABCDEFGHIJKLMNOPQRST=="',
    ]
    docs = spark.createDataFrame([(k, f"password = {v} and so on") for k, v in enumerate(values)], "doc_id long, text string")
    out = {r["doc_id"]: (r["n_entities"], r["text"]) for r in surrogates.replace(docs, "k").collect()}
    assert [k for k, v in enumerate(values) if out[k][0] != 1 or v.strip("\"'") in out[k][1]] == []
    near = spark.createDataFrame([(1, 'a "quite short" quote, "nineteenletterslong" too')], "doc_id long, text string")
    assert surrogates.replace(near, "k").first()["n_entities"] == 0


def test_surrogates_stay_distinct_when_proposals_collide(spark):
    names = [("male", f"A{chr(97 + i)} B{chr(97 + j)}") for i in range(26) for j in range(26)]
    table = surrogates.assign(spark.createDataFrame(names, "kind string, value string"), "k").collect()
    assert len(table) == 676 and len({r["surrogate"] for r in table}) == 676


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=n)


def test_list_entries_are_judged_as_of_the_fetch(spark):
    entries = spark.createDataFrame([
        ("l", "block", "domain", "bad.org", "add", day(10)), ("l", "block", "domain", "bad.org", "remove", day(20)), ("l", "block", "domain", "bad.org", "add", day(50)),
        ("l", "block", "domain", "bad.org", "add", day(60)), ("w", "allow", "prefix", "a.bad.org/ok", "add", day(0)), ("l", "block", "domain", None, "add", day(0)),
        ("x", "block", "domain", "tie.org", "add", day(5)), ("x", "block", "domain", "tie.org", "remove", day(5)),
    ], "list_name string, verdict string, kind string, value string, action string, day date")
    pages = [(1, "http://bad.org/x", day(9)), (2, "http://bad.org/x", day(10)), (3, "https://A.Bad.org:80/y?z", day(19)), (4, "http://bad.org", day(20)), (5, "http://notbad.org/", day(55)),
             (6, "http://a.bad.org/ok/z", day(55)), (7, "http://a.bad.org/okay", day(61)), (8, None, day(3)), (9, "nonsense", day(3)), (10, "http://bad.org/", None), (11, "http://u:p@tie.org./", day(5)),
             (2, "http://bad.org/x", day(10))]
    frame = spark.createDataFrame(pages, "page_id long, url string, fetched_on date").withColumn("value", F.lit("x"))
    got = {r["page_id"]: (r["verdict"], r["value"], r["since"], r["n_captures"]) for r in url_lists.judge(frame, entries).collect()}
    none = ("allow", None, None, 1)
    assert got == {1: none, 2: ("block", "bad.org", day(10), 2), 3: ("block", "bad.org", day(10), 1), 4: none, 5: none, 6: ("allow", "a.bad.org/ok", day(0), 1),
                   7: ("block", "bad.org", day(50), 1), 8: none, 9: none, 10: none, 11: ("block", "tie.org", day(5), 1)}
    assert url_lists.judge(frame.filter("false"), entries).count() == 0
    assert {r["verdict"] for r in url_lists.judge(frame, entries.filter("false")).collect()} == {"allow"}


def test_queries_follow_their_contracts(spark):
    contract = importlib.import_module("__spark_entry__")
    named, sf = contract.queries(), "/root/testdata/sf0.001"
    assert [k for n in range(1, 14) for k in named if k.startswith(f"op{n}_")] == sorted((k for k in named if re.match(r"op\d+_", k)), key=lambda k: int(k[2:].split("_")[0]))
    columns = {"op1": ["doc_id", "held_out", "score", "predicted"], "op2": ["doc_id", "n_shingles", "component_id"], "op6": ["doc_id", "held_out", "score", "predicted"],
               "op7": ["page_id", "url", "text", "n_chars"], "op8": ["query_id", "rank", "vec_id", "score"], "op9": ["doc_id", "n_words", "n_removed", "kept_sha256"]}
    for name in named:
        if want := columns.get(name.split("_")[0]):
            assert named[name](spark, sf).columns[:len(want)] == want


def test_pipeline_equals_its_operators_on_what_is_kept(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    similarity = importlib.import_module("test_similarity")
    from voxelcohort.llm import line_crf, piece_sampling, textgrid

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r["pieces"] for r in pipeline.run(spark, sf).collect()}
    labels = textgrid.table(spark, sf, "labels")
    model = line_crf.fit(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    good = [(r["doc_id"], r["text"]) for r in line_crf.score(docs, model).collect() if r["score"] >= 0.5]
    parts = similarity.brute_components(good)
    single = [(k, t) for k, t in good if parts[k][1] == k]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    leaked = {d for d, _ in similarity.brute_leaks(single, items)}
    assert set(got) == {k for k, _ in single} - leaked
    decoded = piece_sampling.decode(spark.createDataFrame(list(got.items()), "doc_id long, pieces array<int>"), piece_sampling.load_vocabulary())
    private = re.compile(r"@|\+\d|\d{16}|\d\.\d+\.\d|\"\w{20}")
    before = dict(single)
    for r in decoded.collect():
        assert private.search(before[r["doc_id"]]) or r["text"] == before[r["doc_id"]]
