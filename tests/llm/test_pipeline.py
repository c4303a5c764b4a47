import random

import corpus_pipeline
from changelake.llm.plans import QUERIES
from tests.test_queries import SF_DIR


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


def test_stages_do_what_they_say(spark, make_docs, tmp_path):
    rng = random.Random(1)
    clean = [(i, " ".join(words(rng, 80)), f"s{i % 15}") for i in range(60)]
    toxic = [(100 + i, " ".join([*words(rng, 40), "idiot", "moron", "scum"]), "s1") for i in range(30)]
    item = " ".join(words(rng, 30))
    leak = [(200, " ".join(words(rng, 50)) + " " + item, "s2")]
    copies = [(300 + i, clean[0][1] if i % 2 else clean[0][1] + " tail", "s3") for i in range(6)]
    lined = [(400 + i, "\n".join([" ".join(words(rng, 30)), "see our terms and imprint", " ".join(words(rng, 30))]), f"s{i}") for i in range(14)]
    docs = make_docs(*clean, *toxic, *leak, *copies, *lined)
    labels = spark.createDataFrame([(i, 0) for i, *_ in clean] + [(i, 1) for i, *_ in toxic[:25]], "doc_id long, toxic int")
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    seen = docs
    for (name, stage), n in zip(corpus_pipeline.STAGES, (81, 81, 75, 74, 74), strict=True):
        seen = stage(spark, seen, folder)
        assert seen.count() == n, name
        if name == "line dedup":
            assert seen.where("text like '%imprint%'").count() == 1
        if name != "byte-level BPE":
            assert seen.schema == docs.schema
    ids = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    assert ids == {i for i, *_ in clean} | {i for i, *_ in lined}


def test_every_query_runs(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    for name in ("op5_compression_bands", "op9_license_scan", "op10_secret_scan"):
        assert QUERIES[name](spark, SF_DIR).count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()


def test_stages_on_odd_rows(spark, tmp_path):
    """Null and empty texts, null ids, repeated rows, an empty table, and columns named like those that the operators use inside."""
    names = ["removed", "__row_key__", "__text_key__", "__id__", "__key__", "row", "row_key", "text_key", "key", "id", "label", "class_key"]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{n}` string" for n in names)
    rng = random.Random(3)
    body = " ".join(words(rng, 60))
    given = [(1, None), (2, ""), (None, "no id " + " ".join(words(rng, 40))), (4, body), (4, body), (5, " \n "), (6, "x " * 30_000)]
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (None, "some words of an item that nothing holds")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for rows in (given, []):
        docs = spark.createDataFrame([(i, t, None, None, None, *[f"{n}-{i}" for n in names]) for i, t in rows], schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.schema == docs.schema, name
            found = out.collect()
            for r in found:
                assert [r[n] for n in names] == [f"{n}-{r.doc_id}" for n in names], name
            expected = 4 if name == "near-duplicates" and rows else len(rows)  # the three without words, the two equal ones
            if name == "near-duplicates" and rows:
                assert {r.doc_id for r in found} >= {None, 4, 6} and len(found) <= 6
            else:
                assert len(found) == expected, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == len(rows)
