from collections import Counter

from changelake.llm import chat, linededup
from changelake.llm.plans import ORACLE_SQL, QUERIES
from tests import oracle
from tests.test_queries import SF_DIR


def brute(rows, min_sites):
    sites, first = {}, {}
    for i, text, site in rows:
        for line in (text or "").split("\n"):
            key = line.strip(" ")
            if key:
                sites.setdefault(key, set()).update([site] if site is not None else [])
                if i is not None:
                    first[key] = min(first.get(key, i), i)
    out = []
    for i, text, _ in rows:
        parts = (text or "").split("\n")
        gone = [bool(p.strip(" ")) and len(sites[p.strip(" ")]) >= min_sites and i != first.get(p.strip(" ")) for p in parts]
        out.append((i, sum(bool(p.strip(" ")) for p in parts), sum(gone), "\n".join(p for p, g in zip(parts, gone, strict=True) if not g)))
    return Counter(out)


def test_line_dedup_against_brute_force(make_docs):
    rows = [(i, f"own {i}\n menu \nwide line\n\nown {i}", f"s{i % 30}") for i in range(60)]
    rows += [(100 + i, "near line\nnine", f"s{i}") for i in range(9)] + [(200, "near line", "s20"), (201, None, "s1"), (202, "", "s1"), (None, "wide line\nx", "s2")]
    rows += [(300, "wide line", None), (5, "own 5\n menu \nwide line\n\nown 5", "s5"), (301, "z\n" * 20000 + "menu", "s3")]
    got = linededup.dedup_lines(make_docs(*rows)).collect()
    assert Counter(tuple(r) for r in got) == brute(rows, 10)
    kept = linededup.without_boilerplate(make_docs(*rows))
    assert kept.columns == make_docs().columns
    assert Counter((r.doc_id, r.text, r.n_chars) for r in kept.collect()) == Counter(
        {(i, t, len(t)): n for (i, _, _, t), n in brute(rows, 10).items()}
    ) or Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _, _ in rows)
    assert linededup.dedup_lines(make_docs()).count() == 0


def test_estimates_near_the_threshold_are_exact(make_docs):
    rows = [(1000 * n + i, f"line {n}", f"site{i}") for n in (195, 199, 200, 201, 230) for i in range(n)]
    lines = linededup.lines_of(linededup._named(make_docs(*rows), "doc_id", "text", "source"))
    assert linededup.spread_lines(lines, 200).count() == 3


def test_line_dedup_uses_no_python(make_docs):
    plan = linededup.dedup_lines(make_docs((1, "a"), (2, "b")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rotation_renders_every_perspective(spark):
    rows = [(1, 0, "system", "Be kind"), (1, 1, "ann", "Hi"), (1, 2, "bob", "Hello é🙂"), (1, 3, "ann", None), (2, 0, "system", "alone"), (None, None, None, "x"),
            (3, 0, "ann", "same"), (3, 0, "ann", "same")]
    frame = spark.createDataFrame([(*r, "p", "q") for r in rows], "conv_id long, turn long, role string, text string, perspective string, part string")
    got = chat.rotate(frame).collect()
    texts = {}
    for r in sorted(got, key=lambda r: r.position):
        key = (r.conv_id, r.perspective)
        assert r.start == len(texts.get(key, "")) and r.stop - r.start == len(r.segment)
        texts[key] = texts.get(key, "") + r.segment
    assert set(texts) == {(1, "ann"), (1, "bob"), (None, "unknown"), (3, "ann")}
    assert texts[1, "bob"] == "<|system|>\nBe kind<|end|>\n<|user name=ann|>\nHi<|end|>\n<|assistant|>\nHello é🙂<|end|>\n<|user name=ann|>\n<|end|>\n"
    trained = [texts[r.conv_id, r.perspective][r.loss_start : r.loss_stop] for r in got if r.loss_start is not None and r.perspective == "bob"]
    assert trained == ["Hello é🙂<|end|>"]
    assert all((r.role == "assistant") == (r.loss_start is not None) for r in got)
    assert chat.rotate(frame.where("conv_id = 99")).count() == 0


def test_long_dialogue_is_placed_in_parts(spark):
    rows = [(7, i // 3, ["ann", "bob", "eve"][i % 3], f"text {i}") for i in range(6000)]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(16)).where("perspective = 'eve'").collect()
    got.sort(key=lambda r: r.position)
    assert [r.position for r in got] == list(range(6000))
    assert all(a.stop == b.start for a, b in zip(got, got[1:], strict=False))


def test_twins(spark):
    con = oracle.connect(SF_DIR)
    for name in ORACLE_SQL:
        oracle.compare(QUERIES[name](spark, SF_DIR), con, ORACLE_SQL[name])
