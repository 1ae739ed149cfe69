import collections
import gzip
import hashlib
import math
import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from axisframe.llm import ann, components, langid, linededup, mixing, neardup, pagetext, pieces, quality, vectors, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(spark, rows, partitions=3):
    return spark.createDataFrame(rows, DOCS).repartition(partitions)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and columns with names that operators use."""
    rng = random.Random(5)
    long = words(rng, 30_000)
    same = words(rng, 40)
    rows = [(1, None, "en", "a", 1), (2, "", "en", None, 0), (3, "  \t\n ", None, "a", 5), (4, long, "en", "b", None), (5, same, None, "a", 9), (5, same, None, "a", 9), (None, same, "en", "b", 9), (7, words(rng, 30), "en", "b", 1), (7, words(rng, 35), "fr", "b", 1), (8, "!!! ???", "en", "c", 7), (9, None, None, None, None)]
    df = documents(spark, rows)
    for c in ("key", "class", "root", "n", "count", "score", "rank", "target", "epochs", "mix_size", "gone_pos", "gone_id", "th", "words", "lang_pred", "stats", "component_id", "n_dropped", "pos"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(900 + k, 901 + k) for k in range(40)] + [(5, 5), (1, None)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if b is not None:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in up if x in got} and {x for e in edges if e[1] is not None and e[0] != e[1] for x in e} == set(got)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_end_in_one_task_as_in_rounds(spark):
    rng = random.Random(41)
    edges = [(rng.randrange(-400, 400), rng.randrange(-400, 400)) for _ in range(300)] + [(900 + (k * 37) % 200, 900 + (k + 1) * 37 % 200) for k in range(199)] + [(5, 5), (1, None)]
    longs = spark.createDataFrame(edges, "a long, b long")
    names = longs.select(*[F.unhex(F.md5(F.col(c).cast("string"))).alias(c) for c in "ab"])
    for df in (longs, names):
        rounds = sorted(components.components(df).collect())
        for alone in (150, components.ALONE):
            assert sorted(components.components(df, alone=alone).collect()) == rounds
    assert components.components(spark.createDataFrame([], "a long, b long"), alone=9).count() == 0


def brute_near(rows, n, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(low))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)]


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for k in range(25):
        base = words(rng, rng.randrange(1, 120)).split()
        rows.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            copy = list(base)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9)}"
            rows.append(" \n".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    hot = words(rng, 150).split()
    for _ in range(60):
        copy = list(hot)
        copy[rng.randrange(150)] = f"y{rng.randrange(99)}"
        rows.append(" ".join(copy))
    rows += ["", None, "  ", "one", "ONE", "one two"]
    rows = [(i * 3 + 1, t) for i, t in enumerate(rows)]
    rng.shuffle(rows)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_near(rows, 4, 80))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_across_blocks(spark, monkeypatch):
    """Large groups are compared block by block and still hang together."""
    from axisframe.llm import pairblocks

    rng = random.Random(3)
    base = words(rng, 100).split()
    rows = []
    for i in range(50):
        copy = list(base)
        copy[rng.randrange(100)] = f"z{i}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(neardup, "blocked", lambda r, k, i: pairblocks.blocked(r, k, i, 8))
    assert {r.component_id for r in neardup.near_duplicates(df, words=4).collect()} == {0}


def test_near_duplicates_of_odd_rows(odd, none):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == odd.count() and all(r.kept for r in got if r.doc_id in (1, 2, 3, 4, 9))
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id in (5, None)} == {(5, 5), (None, 5)}
    assert neardup.near_duplicates(none).count() == 0


def test_one_row_of_each_component_stays(spark, odd, none):
    """Repeated and null ids neither save a copy nor take another text along."""
    import corpus_pipeline

    rng = random.Random(13)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    near = lambda t: " ".join([*t.split()[:-1], "changed"])
    rows = [(5, a), (5, a), (None, a), (7, b), (7, c), (3, near(b)), (None, d), (None, near(d)), (None, d), (1, None), (1, None), (2, "")]
    docs = documents(spark, [(i, t, "en", "a", 1) for i, t in rows])
    got = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert {k: n for k, n in got.items() if k[0] is not None} == {(5, a): 1, (7, c): 1, (3, near(b)): 1, (1, None): 2, (2, ""): 1}
    assert sum(n for k, n in got.items() if k[0] is None) == 1 and {k[1] for k in got if k[0] is None} <= {d, near(d)}
    assert neardup.one_of_each(odd).columns == odd.columns and neardup.one_of_each(odd).count() == odd.count() - 2
    assert neardup.one_of_each(none).count() == 0


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    jvm = spark._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_near_duplicates_shuffle_only_texts_in_question(spark):
    rng = random.Random(31)
    texts = [" ".join(f"{rng.getrandbits(32):08x}" for _ in range(1500)) for _ in range(200)]
    rows = [*enumerate(texts), (900, texts[3] + " more"), (901, texts[8])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).localCheckpoint()
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = shuffled(spark)
        assert {r.doc_id for r in neardup.one_of_each(docs).select("doc_id").collect()} == set(range(200))
        assert shuffled(spark) - before < sum(len(t) for t in texts) / 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_near_duplicates_write_no_text_down(spark):
    rng = random.Random(11)
    texts = [" ".join(f"{rng.getrandbits(64):x}" for _ in range(2000)) for _ in range(60)]
    near = texts[0].replace(" ", " again ", 1)
    # A row that comes back as it is is one member each time, and its set is compared once.
    rows = [(k, t) for k, t in enumerate(texts)] + [(0, texts[0])] * 300 + [(99, near), (98, near)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    size = lambda: sum(f.stat().st_size for f in shared.rglob("*.parquet"))
    before = size()
    got = collections.Counter((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect())
    assert size() - before < sum(map(len, texts)) / 4
    assert got == {(0, 0, True): 301, (98, 0, False): 1, (99, 0, False): 1} | {(k, k, True): 1 for k in range(1, 60)}


def test_near_duplicates_notice_other_texts(spark):
    text = " ".join(map(str, range(300)))
    docs = spark.createDataFrame([(k, text) for k in range(6)], "doc_id long, text string")
    fresh = F.udf(lambda: f" {random.SystemRandom().getrandbits(64):x}").asNondeterministic()
    with pytest.raises(RuntimeError, match="not the same"):
        neardup.near_duplicates(docs.withColumn("text", F.concat("text", fresh()))).collect()


def test_near_duplicates_take_few_stages(spark):
    """The driver keeps every stage and plan: a chain of copies, each near the next only, costs no round of joins a link."""
    rng = random.Random(43)
    chain = [words(rng, 100).split()]
    for k in range(20):
        chain.append([*chain[-1][: 5 * k], *(f"c{k}x{j}" for j in range(5)), *chain[-1][5 * k + 5 :]])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(chain)], "doc_id long, text string")
    jvm = spark._jvm

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        every = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {every.apply(k).stageId() for k in range(every.size())}

    before = stages()
    assert {r.component_id for r in neardup.near_duplicates(docs, words=4).collect()} == {0}
    assert len(stages() - before) < 120


def test_marked_misses_none(spark, monkeypatch):
    """Every row in question is marked, whatever room the map has, and few others."""
    from axisframe.llm import common

    rows = spark.range(5000).withColumn("id", F.when(F.col("id") > 0, F.col("id")))
    some = spark.range(1, 5000, 9)
    own = {r.id for r in some.collect()}
    for each, top in ((16, 800), (0, 800)):
        monkeypatch.setattr(common, "VALUE_BITS", each)
        got = common.marked(rows, "id", some).collect()
        assert len(got) == 5000 and own <= {r.id for r in got if r.marked} and len(own) <= sum(r.marked for r in got) <= top


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(4)
    pool = [words(rng, rng.randrange(3, 12), 30).split() for _ in range(25)]
    rows = []
    for i in range(40):
        out = []
        for _ in range(rng.randrange(1, 8)):
            line = list(rng.choice(pool))
            r = rng.random()
            if r < 0.2:
                line[rng.randrange(len(line))] = "new"
            elif r < 0.3:
                del line[rng.randrange(len(line))]
            elif r < 0.4:
                line.insert(rng.randrange(len(line) + 1), "more")
            elif r < 0.5:
                line = line[1:] + line[:1]
            out.append((" ", "  ", "\t")[rng.randrange(3)].join(line))
        rows.append((i, "\n".join(out)))
    rows += [(100, None), (101, ""), (102, "a b c d e " * 3000)]
    rng.shuffle(rows)
    seen, want = [], {}
    for i, text in sorted(rows):
        kept = []
        for line in (text.split("\n") if text is not None else []):
            w = line.split()
            if len(w) >= 5 and any(one_apart(w, x) for x in seen):
                pass
            else:
                kept.append(line)
            if len(w) >= 5:
                seen.append(w)
        want[i] = "\n".join(kept) if text is not None else None
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == want
    assert {r.doc_id: r.n_lines for r in got}[100] == 0 and {r.doc_id: r.n_lines for r in got}[101] == 1


def test_line_dedup_of_odd_rows(odd, none):
    got = linededup.dedup_lines(odd).collect()
    assert len(got) == odd.count() and linededup.dedup_lines(none).count() == 0
    # The null id comes first, so rows with id 5 lose the line, the two alike.
    assert [r.text for r in got if r.doc_id == 5] == ["", ""] and next(r.text for r in got if r.doc_id is None)
    assert all(r.key == "clash" for r in got)
    plan = linededup.dedup_lines(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def brute_targets(sizes):
    names = sorted(k for k in sizes if k is not None) + ([None] if None in sizes else [])
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    cap = {}
    while True:
        rest = [k for k in names if k not in cap]
        left, heavy = sum(sizes.values()) - sum(cap.values()), sum(weight[k] for k in rest)
        over = [k for k in rest if left * weight[k] / heavy > 3 * sizes[k] + 1e-9]
        if not over:
            return {**cap, **{k: left * weight[k] / heavy for k in rest}}
        cap |= {k: 3 * sizes[k] for k in over}


@pytest.mark.parametrize("seed", range(4))
def test_targets_match_resharing(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": int(10 ** rng.uniform(0, 4)) for i in range(rng.randint(1, 12))} | ({None: 500, "zero": 0} if seed % 2 else {})
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = brute_targets(sizes)
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)


def test_mix_takes_what_it_should(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, rng.randrange(1, 60)) + (" ###" * 9 if i % 5 == 0 else ""), "en", rng.choice(["a", "a", "a", "b", "c", "d", None]), 1) for i in range(400)]
    df = documents(spark, rows)
    got = mixing.plan_mix(df).collect()
    assert sorted(got) == sorted(mixing.plan_mix(df.repartition(7)).collect())
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert r.size == len(WORD.findall(dict((x[0], x[1]) for x in rows)[r.doc_id])) and 0 <= r.taken <= 3 * r.size
    for rs in by.values():
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 1
        # Whole epochs first: taken differs from them by at most one epoch, and by a part of it for one document.
        whole = math.floor(rs[0].target / rs[0].source_size)
        assert sum(r.taken not in (whole * r.size, (whole + 1) * r.size) for r in rs) <= 1
    noisy = [r.taken > 0 for r in got if r.doc_id % 5 == 0 and r.target < r.source_size]
    clean = [r.taken > 0 for r in got if r.doc_id % 5 and r.target < r.source_size]
    assert sum(noisy) / len(noisy) < sum(clean) / len(clean)


def test_mix_of_odd_rows(odd, none):
    got = mixing.plan_mix(odd).collect()
    assert len(got) == odd.count() and next(r for r in got if r.doc_id == 1).taken == 0
    assert mixing.mix(odd).columns == odd.columns and mixing.mix(odd).count() > 0
    assert mixing.plan_mix(none).count() == 0 and mixing.mix(none).count() == 0


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(7)
    big = "é" * 50_000 + words(rng, 9_000)
    rows = [(1, "http://a/ x", "short"), (2, None, "y" * 1000), (3, "http://b", "y" * 1000), (4, "http://b", big), (5, "u", big), (6, "u", None), (7, "u", "\r\n\r\nWARC/1.1\r\n" * 90), (8, "u", "y" * 999), (9, "u", "y" * 999), (9, "u", "y" * 999), (None, "u", "z" * 2000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write_warc(df, f"file://{tmp_path}/w", segment=20_000)
    got = {r.page_id: r for r in warc.read_warc(spark, f"file://{tmp_path}/w", payloads=True).collect()}
    assert set(got) == {r[0] for r in rows}
    for i, _, html in rows:
        raw = (html or "").encode()
        r = got[i]
        same = [j for j, _, h in rows if (h or "").encode() == raw and j is not None]
        owner = max(same) if len(raw) >= 1000 and same else i
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if owner == i else ("revisit", owner))
        assert r.record_type == "revisit" or bytes(r.payload) == raw
    warc.write_warc(df.limit(0), f"file://{tmp_path}/none")
    assert warc.read_warc(spark, f"file://{tmp_path}/none").count() == 0


def test_warc_keeps_every_row(spark, tmp_path):
    """Repeated rows, also without a page_id, come back as often; a revisit refers to one record."""
    rows = [(9, "u", "y" * 999)] * 2 + [(None, "u", None)] * 3 + [(None, "v", "")] + [(None, "u", "z" * 2000)] * 2 + [(5, "u", "z" * 2000)] * 3 + [(4, "u", "z" * 2000)] * 2 + [(8, "u", "long " * 9000)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write_warc(df, f"file://{tmp_path}/w", segment=20_000)
    got = collections.Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_warc(spark, f"file://{tmp_path}/w").collect())
    want = {(9, 999, "response", None): 2, (None, 0, "response", None): 4, (None, 2000, "response", None): 2, (5, 2000, "response", None): 3, (4, 2000, "revisit", 5): 2, (8, 45_000, "response", None): 2}
    assert got == want
    ids = [r.id for r in warc.read_records(spark, f"file://{tmp_path}/w").collect()]
    assert len(ids) == len(set(ids))


def test_warc_refuses_broken_records(spark, tmp_path):
    def record(kind, ident, block, *more):
        return ("\r\n".join(["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ident}>", f"Content-Length: {len(block)}", *more]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"

    body = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5;x=1\r\nhello\r\n3\r\n wo\r\n0\r\n\r\n"
    parts = [record("response", "a", body[:30], "X-Page-ID: 1", "WARC-Segment-Number: 1"), record("continuation", "b", body[30:60], "WARC-Segment-Origin-ID: <a>", "WARC-Segment-Number: 2"), record("continuation", "c", body[60:], "WARC-Segment-Origin-ID: <a>", "WARC-Segment-Number: 3", f"WARC-Segment-Total-Length: {len(body)}")]
    (tmp_path / "ok").mkdir()
    # Members one after the other, segments over two files and out of order.
    (tmp_path / "ok/1.warc.gz").write_bytes(gzip.compress(parts[2]) + gzip.compress(parts[0]))
    (tmp_path / "ok/2.warc").write_bytes(parts[1])
    r = warc.read_warc(spark, f"{tmp_path}/ok", payloads=True).collect()
    assert [(bytes(x.payload), x.payload_bytes) for x in r] == [(b"hello wo", 8)]
    for name, content in (("gap", [parts[0], parts[2]]), ("length", [parts[0], parts[1], parts[2].replace(f"Length: {len(body)}".encode(), b"Length: 7")])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.warc").write_bytes(b"".join(content))
        with pytest.raises(Exception, match="segment"):
            warc.read_warc(spark, f"{tmp_path}/{name}").collect()
    with pytest.raises(ValueError):
        warc.decode_chunked(b"5\r\nhel\r\n0\r\n\r\n")


def test_language_field_on_held_out_and_switched_text(spark):
    rng = random.Random(8)
    stems = {"x1": ["ka", "ki", "to", "mu", "sha"], "x2": ["grün", "berg", "sch", "ung", "ße"], "x3": ["eau", "oir", "que", "ment", "é"]}
    text = lambda lang, n: " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, text(lang, 40) + "\n" + text(lang, 5), lang, None, 0) for i, lang in enumerate(rng.choices(list(stems), k=150))]
    rows += [(1000, None, "x1", None, 0), (1001, "", "x1", None, 0), (1002, "12 -- ###", None, None, 0), (1003, "١٢ ——", None, None, 0)]
    df = documents(spark, rows)
    got = {r.doc_id: r for r in langid.languages(df).collect()}
    truth = {r[0]: r[2] for r in rows}
    assert all(got[i].lang_pred == truth[i] and 0.5 < got[i].score <= 1 for i in range(150))
    assert all((got[i].lang_pred, got[i].score) == ("und", 0) for i in (1000, 1001, 1002, 1003))
    import zlib

    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    field = langid.learn(df)
    mixed = spark.createDataFrame([(1, text("x1", 12) + " " + text("x2", 12))], "doc_id long, text string")
    tags = [w.lang for w in langid.tag_words(mixed, field).first().words]
    assert tags[:10] == ["x1"] * 10 and tags[-10:] == ["x2"] * 10


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    e, steps = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    chains = np.array([0, 4, 5, 7])
    p, pairs = langid.marginals(e, chains, steps, pairs=True)
    import itertools

    want, both = np.zeros((7, 3)), np.zeros((3, 3))
    for a, b in zip(chains[:-1], chains[1:], strict=True):
        paths = list(itertools.product(range(3), repeat=b - a))
        score = np.array([np.exp(sum(e[a + k, y] for k, y in enumerate(s)) + sum(steps[s[k], s[k + 1]] for k in range(len(s) - 1))) for s in paths])
        score /= score.sum()
        for s, w in zip(paths, score, strict=True):
            for k, y in enumerate(s):
                want[a + k, y] += w
            for k in range(len(s) - 1):
                both[s[k], s[k + 1]] += w
    assert np.allclose(p, want) and np.allclose(pairs, both)


def plain_chain(e, steps):
    """Posteriors of one chain by the textbook recursions, in logarithms."""
    n, k = e.shape
    f, b = np.zeros((n, k)), np.zeros((n, k))
    f[0] = e[0]
    for t in range(1, n):
        f[t] = e[t] + np.logaddexp.reduce(f[t - 1][:, None] + steps, axis=0)
    for t in range(n - 2, -1, -1):
        b[t] = np.logaddexp.reduce(steps + (e[t + 1] + b[t + 1])[None], axis=1)
    p = f + b
    return np.exp(p - np.logaddexp.reduce(p, axis=1)[:, None])


def test_chains_are_never_cut():
    """Blocks of any size give the posteriors of whole chains, and a text in parts those of the text."""
    rng = np.random.default_rng(2)
    e, steps = rng.normal(size=(1200, 4)) * 2, rng.normal(size=(4, 4)) * 2
    chains = np.array([0, 1, 700, 703, 1200])
    want = np.concatenate([plain_chain(e[a:b], steps) for a, b in zip(chains[:-1], chains[1:], strict=True)])
    whole, pairs = langid.marginals(e, chains, steps, pairs=True, size=10_000)
    assert np.allclose(whole, want)
    for size in (1, 7, 256):
        p, q = langid.marginals(e, chains, steps, pairs=True, size=size)
        assert np.allclose(p, want) and np.allclose(q, pairs)
    r = random.Random(3)
    texts = [" ".join(r.choice(["ka", "ki", "tom", "über", "schön"]) for _ in range(600)) for _ in range(4)]
    lexicon = np.zeros((2, langid.LEXICON), np.float32)
    field = langid.train_field([t.replace("ü", "y") for t in texts[:2]] + ["eau oir " * 300] * 2, ["a", "b"], ["a", "a", "b", "b"], lexicon)
    text = pa.array([texts[3] + "\n" + "eau oir " * 200])
    lang, score = langid.label_texts(text, field)
    for most in (50, 777):
        got = langid.label_texts(text, field, most)
        assert got[0] == lang and np.allclose(got[1], score)
    f = langid.Features(text)
    p = plain_chain(field.emissions(f).astype(float), field.steps)[f.lettered].mean(0)
    assert lang == [field.langs[p.argmax()]] and np.isclose(score[0], p.max())


def test_language_of_odd_rows(odd, none):
    got = langid.languages(odd).collect()
    assert len(got) == odd.count() and {r.lang_pred for r in got if r.doc_id in (1, 2, 3, 8, 9)} == {"und"}
    assert langid.languages(none).count() == 0
    assert set(odd.columns) <= set(langid.with_language(odd, None).columns)


def test_quality_separates_and_holds_out(spark):
    rng = random.Random(9)
    good = lambda: "\n".join(words(rng, 30, 3000) + "." for _ in range(4))
    bad = lambda: " ".join(["BUY!!", "NOW!!", "$$$"] * 30)
    rows = [(i, good() if i % 3 else bad(), None, None, 0) for i in range(240)] + [(500, "", None, None, 0), (501, None, None, None, 0)]
    labels = spark.createDataFrame([(i, int(bool(i % 3)), 0) for i in range(240)] + [(0, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_scores(documents(spark, rows), labels).collect()}
    assert all(got[i].predicted == int(bool(i % 3)) for i in range(240)) and all(0 <= r.score <= 1 for r in got.values())
    assert got[500].score == got[501].score and sum(r.held_out for r in got.values()) > 30
    one = quality.quality_scores(documents(spark, rows), labels.where("quality = 1")).first()
    assert one.score == 1.0 and quality.quality_scores(documents(spark, rows), labels.limit(0)).first().score == 0.5


def test_quality_statistics_match_plain_ones():
    texts = ["a b a b. \nCC!! $$ 12", "", None, "één woord"]
    x = quality.statistics(pa.array(texts))
    w = [WORD.findall(t or "") for t in texts]
    assert np.allclose(x[:, 0], [np.log1p(len(v)) for v in w])
    assert np.allclose(x[0, quality.NAMES.index("distinct")] ** 2, len({t.lower() for t in w[0]}) / len(w[0]))
    assert np.allclose(x[0, quality.NAMES.index("share_shout")] ** 2, 2 / len(texts[0])) and not x[1].any() and not x[2].any()


def test_discriminant_matches_plain_densities(spark):
    """Scores from the sums of all rows equal those of densities that are worked out directly."""
    rng = np.random.default_rng(6)
    p = len(quality.NAMES)
    x = np.concatenate([rng.normal(size=(80, p)), rng.normal(size=(60, p)) * 1.5 + 0.4])
    y = np.array([0] * 80 + [1] * 60)
    train = spark.createDataFrame([(int(k), [float(v) for v in row]) for k, row in zip(y, x, strict=True)], "quality int, stats array<double>").repartition(3)
    model = quality.fit(train)
    own = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    pooled = (own[0] * 80 + own[1] * 60) / 140
    logs = []
    for k, n in ((0, 80), (1, 60)):
        s = ((1 - quality.POOLED) * n * own[k] + quality.POOLED * 140 * pooled) / ((1 - quality.POOLED) * n + quality.POOLED * 140)
        s = (1 - quality.DIAGONAL) * s + quality.DIAGONAL * np.diag(np.diag(s)) + 1e-6 * np.eye(p)
        d = x - x[y == k].mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1])
    assert np.allclose(model.difference(x), logs[1] - logs[0])
    t = model.slope * np.clip(logs[1] - logs[0], -quality.REACH, quality.REACH) + model.offset
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-t))) and model.slope > 0 and abs(model.score(x).mean() - y.mean()) < 0.02


def test_quality_of_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(4, 1), (7, 0)], "doc_id long, quality int")
    assert quality.quality_scores(odd, labels).count() == odd.count() and quality.quality_scores(none, labels).count() == 0


ODD_TEXTS = ["", " ", "  a  b ", "日本語 テスト😀x", "▁a ▁▁b", "a\n\n b\t\tc ", "ß" * 100, "x" * 500, "é   z", "<s> </s> <unk> <0x41>", "\0a", "� x", "The quick brown fox." * 30, "\r\n\r\n", "a b", "word " * 2000]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece.SentencePieceProcessor(model_file=path), path


def test_pieces_match_the_library(spark, library):
    sp, path = library
    model = pieces.Model(pieces.model_bytes(path))
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for t in ODD_TEXTS + docs:
        ids = sp.encode(t)
        assert model.encode(t) == ids and model.decode(ids) == sp.decode(ids)
    rows = list(enumerate(ODD_TEXTS)) + [(99, None), (0, "")]
    got = pieces.token_digests(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = sp.encode(dict(rows)[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())


def test_piece_spans_are_those_of_the_original(spark, library):
    _, path = library
    model = pieces.Model(pieces.model_bytes(path))
    for t in ODD_TEXTS:
        raw = t.encode()
        at = 0
        for i, a, b in model.spans(t):
            assert a <= b and a >= at - 4 and (a >= at or raw[a:b].decode())
            p = model.pieces[i].replace(pieces.SPACE, " ")
            assert model.kinds[i] == 6 or raw[a:b].decode().replace(pieces.SPACE, " ") in (p, p[1:])
            at = max(at, b)
        assert at == len(raw)
    df = pieces.encode(spark.createDataFrame([(1, "日x a"), (2, None)], "doc_id long, text string"), path)
    assert [r.decoded for r in pieces.decode(df, path).orderBy("doc_id").collect()] == ["日x a", ""]


def test_workers_forget_segments_after_a_task(spark, library):
    docs = spark.createDataFrame([(k, f"remembered{k} segments") for k in range(64)], "doc_id long, text string").repartition(8)
    pieces.token_digests(docs, library[1]).collect()

    def held(batches):
        for batch in batches:
            todo, n = [pieces._models], 0
            while todo:
                x = todo.pop()
                n += isinstance(x, str) and "remembered" in x
                todo += [*x, *x.values()] if isinstance(x, dict) else x if isinstance(x, tuple) else ()
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    assert not sum(r[0] for r in spark.range(8).repartition(8).mapInArrow(held, "n long").collect())


def test_character_map_takes_the_longest_prefix():
    """A map that turns ab into X and a into Y: the double array is laid out by hand."""
    units = [0] * 512
    unit = lambda label, offset, leaf=0: label | offset << 10 | leaf << 8
    # The root's children lie at 256 ^ label, those of a at 128 ^ label.
    units[0] = unit(0, 256)
    a = 256 ^ ord("a")
    units[a] = unit(ord("a"), a ^ 128, 1)
    units[128] = 1 << 31 | 0
    b = 128 ^ ord("b")
    units[b] = unit(ord("b"), b ^ 64, 1)
    units[64] = 1 << 31 | 2
    blob = (len(units) * 4).to_bytes(4, "little") + b"".join(u.to_bytes(4, "little") for u in units) + b"Y\0X\0"
    m = pieces.CharMap(blob)
    assert m.longest(b"abc", 0) == (2, b"X") and m.longest(b"ac", 0) == (1, b"Y") and m.longest(b"c", 0) is None
    model = object.__new__(pieces.Model)
    model.charmap, model.trim, model.dummy, model.escape = m, True, True, True
    assert model.normalise(" abé  a ") == ("▁Xé▁Y", [1, 1, 3, 5, 7, 9]) or model.normalise(" abé  a ")[0] == "▁Xé▁Y"


def brute_vectors(rows, threshold):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    x = np.array([v / np.linalg.norm(v) for _, v in good])
    s = x @ x.T >= threshold
    np.fill_diagonal(s, False)
    return [i for i, _ in good], s


def test_near_vectors_match_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 24))
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(base)]
    for k in range(90):
        v = base[k % 20] + rng.normal(size=24) * (0.15 if k % 2 else 0.45)
        rows.append((100 + k, v.tolist()))
    rows += [(300 + k, (base[3] * 1.0).tolist()) for k in range(4)] + [(400, (base[3] * 2).tolist())]
    bad = [(500, None), (501, []), (502, [0.0] * 24), (503, [float("nan")] + [1.0] * 23), (504, [None] + [1.0] * 23), (505, [1.0, 2.0]), (506, [float("inf")] + [1.0] * 23)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    ids, s = brute_vectors(rows, 0.9)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in zip(*np.nonzero(s), strict=True):
        x, y = find(ids[a]), find(ids[b])
        up[max(x, y)] = min(x, y)
    assert {i: (got[i].n_links, got[i].component_id) for i in ids} == {i: (int(s[k].sum()), find(i)) for k, i in enumerate(ids)}
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, _ in bad)
    assert vectors.near_vectors(df.limit(0)).count() == 0 and len(got) == len(rows) + len(bad)


def test_near_vectors_of_every_dimension(spark):
    """Vectors link within their dimension, however rare it is, and never across."""
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(40)]
    rows += [(100, [1.0, 2.0]), (101, [1.0, 2.0]), (102, [1.0, 2.001]), (103, [1.0, 2.0, 0.0]), (200, rng.normal(size=130).tolist())]
    rows += [(201, [*rows[-1][1][:-1], 0.0]), (300, [5.0]), (301, [2.0]), (302, [-1.0])]
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    for i, v in rows:
        near = [j for j, w in rows if j != i and len(w) == len(v) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.9]
        assert got[i].n_links == len(near), i
    assert [got[i].component_id for i in (100, 101, 102, 200, 201, 300, 301, 302)] == [100, 100, 100, 200, 200, 300, 300, 302]


def test_no_link_lies_below_the_threshold(spark):
    """Many pairs just below and just above: every accepted pair has its exact product."""
    rng = np.random.default_rng(8)
    base = np.eye(64)[0]
    rows = []
    for k in range(300):
        side = rng.normal(size=64)
        side[0] = 0
        side /= np.linalg.norm(side)
        c = 0.9 + (1e-9 if k % 2 else -1e-9)
        rows.append((k + 1, (c * base + math.sqrt(1 - c * c) * side).tolist()))
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame([(0, base.tolist()), *rows], "vec_id long, embedding array<double>")).collect()}
    x = np.array([base, *[v for _, v in rows]])
    s = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T >= 0.9
    np.fill_diagonal(s, False)
    assert all(got[k].n_links == int(s[k].sum()) for k in range(301)) and got[0].n_links == 150


def test_tables_are_planned_for_shared_signs():
    assert vectors.missed(14, 145, 1 - math.acos(0.9) / math.pi, 1024) <= 1e-6 < vectors.missed(14, 144, 1 - math.acos(0.9) / math.pi, 1024) * 1.2
    assert 1e-5 < vectors.missed(14, 130, 1 - math.acos(0.9) / math.pi, 256) < 1e-3


def test_near_vectors_across_blocks(spark, monkeypatch):
    from axisframe.llm import pairblocks

    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 0.05).tolist()) for i in range(40)]
    monkeypatch.setattr(vectors, "blocked", lambda r, k, i: pairblocks.blocked(r, k, i, 6))
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all((r.n_links, r.component_id) == (39, 0) for r in got)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 64))
    x[150:] = x[:150] + rng.normal(size=(150, 64)) * 0.4
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code, factor = vectors.codes(x)
    guess, error = vectors.estimates((x @ vectors.rotation(64, 256)).astype(np.float32), code, factor)
    off = guess - x @ x.T
    np.fill_diagonal(off, 0)
    assert abs(off.mean()) < 0.002 and (np.abs(off) <= 5 * error).all()


def test_nearest_finds_neighbours(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(900, 16)), np.repeat(rng.normal(size=(1, 16)), 30, axis=0)])
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2100, [0.0] * 16), (2200, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = ann.nearest(df, lambda i: i % 100 == 0, shard=400, beam=120).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.query_id].append(r)
    hits = 0
    for q in range(0, 930, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(x)), d))[:10]
        rs = sorted(by[q], key=lambda r: r.rank)
        assert [r.rank for r in rs] == list(range(1, 11)) and np.allclose([r.score for r in rs], d[[r.vec_id for r in rs]])
        assert [(r.score, r.vec_id) for r in rs] == sorted((r.score, r.vec_id) for r in rs)
        hits += len({r.vec_id for r in rs} & set(want.tolist()))
    assert hits >= 90 and set(by) == set(range(0, 930, 100))


def test_nearest_crosses_between_groups_and_copies(spark):
    """Tight groups larger than a node's neighbours have no edges to each other; a third of the rows is one vector."""
    rng = np.random.default_rng(12)
    x = np.repeat(rng.normal(size=(70, 24)), 50, axis=0) + rng.normal(size=(3500, 24)) * 0.1
    x = rng.permutation(np.concatenate([x, np.repeat(rng.normal(size=(1, 24)), 1700, axis=0)]))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    by = collections.defaultdict(list)
    for r in ann.nearest(df, lambda i: i % 40 == 0, shard=2000, beam=100).collect():
        by[r.query_id].append(r.score)
    hits = 0
    for q in range(0, len(x), 40):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = np.sort(np.delete(d, q))[:10]
        assert len(by[q]) == 10
        hits += sum(s <= want[-1] + 1e-9 for s in by[q])
    assert hits >= 0.99 * 10 * len(by) and len(by) == len(range(0, len(x), 40))


def test_nearest_of_thousands_of_copies_and_of_every_dimension(spark):
    """Ties go to the smallest ids though a node and a beam hold fewer; dimensions are searched apart."""
    rng = np.random.default_rng(14)
    x = np.concatenate([rng.normal(size=(600, 8)), np.repeat(rng.normal(size=(1, 8)), 900, axis=0)])
    order = rng.permutation(len(x))
    rows = [(int(i), x[k].tolist()) for i, k in enumerate(order)] + [(5000 + i, [float(i), 1.0]) for i in range(15)]
    got = collections.defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), lambda i: i % 100 == 0, shard=500, beam=60).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    copies = [i for i, k in enumerate(order) if k >= 600]
    for q in [q for q in range(0, len(x), 100) if order[q] >= 600]:
        assert [v for _, v, _ in sorted(got[q])] == [i for i in copies if i != q][:10]
    assert [(v, s) for _, v, s in sorted(got[5000])] == [(5000 + i, float(i)) for i in range(1, 11)]


def test_nearest_of_few_rows_gives_all(spark):
    df = spark.createDataFrame([(0, [0.0, 1.0]), (100, [1.0, 1.0]), (5, [2.0, 1.0]), (0, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df, lambda i: i % 100 == 0).orderBy("query_id", "rank", "vec_id").collect()]
    assert got.count((0, 1, 0, 0.0)) == 2 and [g for g in got if g[0] == 100] == [(100, 1, 0, 1.0), (100, 2, 0, 1.0), (100, 3, 5, 1.0)]
    assert ann.nearest(df.limit(0), lambda i: i % 100 == 0).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a = "</p><article>";</script></head><body>
<header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice"><p>We use cookies</p></div>
<!-- <p>hidden</p> --><article><header><h1>Head&nbsp;line</h1></header><p>One &lt;two&gt;
 three<br>four <b>bold</b></p><div class="ad"><div>Buy</div> now</div><p>Fi<i>v</i>e<ul><li>a<li>b</ul><form><input><p>name</p></form><section id="comments"><p>first!</p></section></article>
<aside><p>Side</p></aside><footer>&copy; x</footer></body></html>"""


def test_page_text_of_a_marked_article(spark):
    df = spark.createDataFrame([(1, "http://h/a/1", PAGE), (2, None, None), (3, "no url", ""), (4, "http://h/a/2", "plain <text> 1 < 2 & 3"), (1, "http://h/a/1", PAGE)], "page_id long, url string, html string")
    got = pagetext.extract(df.withColumn("text", F.lit("clash"))).collect()
    assert len(got) == 5
    texts = {r.page_id: r.text for r in got}
    assert texts[1] == "Head line\nOne <two> three four bold\nFive\na\nb" and texts[2] == texts[3] == "" and texts[4] == "plain 1 < 2 & 3"
    assert all(r.n_chars == len(r.text) for r in got) and pagetext.extract(df.limit(0)).count() == 0


def test_pages_without_marks_lose_what_neighbours_share(spark):
    page = lambda *body: "<html><body>" + "".join(f"<div>{x}</div>" for x in body) + "</body></html>"
    df = spark.createDataFrame([(1, "http://h/x/1", page("Menu", "Alpha story", "more", "Imprint")), (2, "http://h/x/2", page("Menu", "Beta story", "Imprint")), (3, "http://other/x/3", page("Menu", "Gamma"))], "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: (r.text, r.n_shared) for r in pagetext.extract(df).collect()}
    assert got[1] == ("Alpha story\nmore", 2) and got[2] == ("Beta story", 2) and got[3] == ("Menu\nGamma", 0)


def test_mirrored_pages_keep_their_text(spark):
    """Copies on a host are not held against each other but against the closest page that differs."""
    page = lambda *body: "<html><body>" + "".join(f"<div>{x}</div>" for x in body) + "</body></html>"
    story = [f"Story line {k}" for k in range(12)]
    rows = [(k, f"http://h/x/{k}", page("Menu", *story, "Imprint")) for k in range(1, 4)] + [(4, "http://h/x/4", page("Menu", *story[:-1], "changed", "Imprint"))]
    rows += [(5, "http://h/y/1", page("Menu", "Other", "Imprint"))] + [(k, f"http://m/x/{k}", page(*story)) for k in (6, 7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: r.text for r in pagetext.extract(df).collect()}
    whole = "\n".join(story)
    assert got == {1: whole, 2: whole, 3: whole, 4: "\n".join([*story[:-1], "changed"]), 5: "Other", 6: whole, 7: whole}


def plain_text(rows, k):
    """What the page at a place in (host, path, page_id) order keeps, worked out over the whole list."""
    pages = [(host, path, pagetext.parse(html)) for host, path, _, html in rows]
    host, path, page = pages[k]
    chars = lambda lines: sum(map(len, lines))
    steps = lambda p: next((n for n, (x, y) in enumerate(zip(path.split("/"), p.split("/"), strict=False)) if x != y), min(path.count("/"), p.count("/")) + 1)
    near = sorted(((-steps(pages[j][1]), abs(j - k), j > k, j) for j in range(max(0, k - pagetext.WINDOW), min(len(pages), k + pagetext.WINDOW + 1)) if j != k and pages[j][0] == host))
    chosen = []
    for *_, j in near:
        a, b = set(page.lines), set(pages[j][2].lines)
        if len(chosen) < pagetext.NEIGHBOURS and a - b and 5 * chars(a ^ b) >= chars(a | b) and all(b != set(c.lines) for c in chosen):
            chosen.append(pages[j][2])
    shared = collections.Counter()
    for other in chosen:
        table = [[0] * (len(other.lines) + 1) for _ in range(len(page.lines) + 1)]
        for i in range(len(page.lines) - 1, -1, -1):
            for j in range(len(other.lines) - 1, -1, -1):
                table[i][j] = table[i + 1][j + 1] + 1 if page.lines[i] == other.lines[j] else max(table[i + 1][j], table[i][j + 1])
        assert len(pagetext.aligned(page.lines, other.lines)) == table[0][0]
        shared.update(pagetext.aligned(page.lines, other.lines))
    marked = page.marked and any(page.article)
    keep = lambda i: not page.outside[i] and (page.article[i] or not marked) and not (shared[i] == len(chosen) >= pagetext.ALL_OF if page.article[i] else 2 * shared[i] > len(chosen))
    return "\n".join(line for i, line in enumerate(page.lines) if keep(i))


def test_page_text_does_not_depend_on_where_parts_end(spark, monkeypatch):
    """Against a plain version over the whole list, with parts of any size."""
    rng = random.Random(15)
    rows, page_id = [], 0
    for host in ("a.x", "b.x"):
        for section in range(3):
            menu = [f"{host} menu {k}" for k in range(4)] + [f"section {section}"]
            for _ in range(14):
                page_id += 1
                body = [f"line {rng.randrange(40)} of some story" for _ in range(rng.randrange(1, 7))]
                inner = "".join(f"<p>{x}</p>" for x in body)
                inner = f"<article>{inner}<p>Follow us</p></article>" if section == 1 else inner
                copy = rows[-1][3] if rows and rng.random() < 0.15 and rows[-1][0] == host else None
                rows.append((host, f"/s{section}/{rng.randrange(90):02}", page_id, copy or "<html><body>" + "".join(f"<div>{m}</div>" for m in menu) + inner + "<div>Imprint</div></body></html>"))
    rows.sort()
    want = {r[2]: plain_text(rows, k) for k, r in enumerate(rows)}
    assert any("Follow us" not in want[r[2]] for r in rows if "Follow us" in r[3]) and all(want.values())
    df = spark.createDataFrame([(i, f"http://{h}{p}", html) for h, p, i, html in rows], "page_id long, url string, html string").repartition(5)
    for part in (20, 33, 1000):
        monkeypatch.setattr(pagetext, "PART", part)
        assert {r.page_id: r.text for r in pagetext.extract(df).collect()} == want


def test_alignment_of_lines_that_repeat_very_often():
    a, b = ["x", "y"] * 20_000, ["y", "x", "x"] * 12_000
    assert len(pagetext.aligned(a, b)) > 30_000


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(10)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = pagetext.aligned(a, b)
        it = iter(b)
        assert len(got) == best[-1][-1] and all(a[k] in it for k in sorted(got))


def test_pipeline_stages_of_odd_and_empty_tables(spark, odd, none, tmp_path):
    import corpus_pipeline

    for docs in (odd.drop("mix_size"), none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert name == "tokens" or out.columns == docs.columns
            rows = out.collect()
            assert rows or docs is none


def test_pipeline_stages_hold_together(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    text = lambda: "\n".join("The and of " + words(rng, 20, 5000) for _ in range(6))
    base = [text() for _ in range(60)]
    near = base[0].split("\n")
    near = "\n".join(" ".join([*x.split()[:-3], "a", "b", "c"]) for x in near)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(100, base[1], "en", "s0", len(base[1])), (101, "### 123", "en", "s0", 7), (102, None, None, None, None), (103, near, None, "s1", len(near))]
    docs = documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "tokens":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in docs.collect()}
    assert kept["language"] == {r[0] for r in rows} - {101, 102}
    assert kept["lines"] == kept["language"] - {100} and set(range(60)) <= kept["near_duplicates"]
    assert kept["tokens"] == kept["mixture"] <= kept["near_duplicates"]
