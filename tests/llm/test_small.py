"""Operators against brute force on the small corpus."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from . import fixtures
from .fixtures import CLASHING, corpus, frame

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ------------------------------------------------------------- sharding


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000])
def test_permutation_is_one_and_has_an_inverse(n):
    from tidemill.llm.sharding import permute, place_of, row_at

    p = permute(np.arange(n), n, 5)
    assert sorted(p.tolist()) == list(range(n))
    assert permute(p, n, 5, inverse=True).tolist() == list(range(n))
    assert all(row_at(*place_of(r, n, 4, 5), n, 4, 5) == r for r in range(n))


def test_shards_are_even_gapless_and_reproducible(spark):
    from tidemill.llm.sharding import feistel_shards, place_of

    rows = feistel_shards(spark, frame(spark, clashing=True).drop("rn", "before", "shard"), ["doc_id", "text"], 7, seed=3).collect()
    again = feistel_shards(spark, frame(spark).repartition(2), ["doc_id", "text"], 7, seed=3).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "", r["shard"], r["slot"]) for r in rows) == sorted((r["doc_id"] or -1, r["text"] or "", r["shard"], r["slot"]) for r in again)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        assert (r["shard"], r["slot"]) == place_of(r["row_number"], len(rows), 7, 3)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


# ----------------------------------------------------- repeated strings


def brute_repeats(texts, length):
    count = collections.Counter(t[a : a + length] for t in texts for a in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - length + 1):
            if count[t[a : a + length]] > 1:
                gone[a : a + length] = True
        out.append(bytes(np.frombuffer(t, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeats_are_removed_as_by_brute_force(spark, monkeypatch, hot):
    from tidemill.llm import substrings

    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "SHARD", 3000)
    rows = substrings.remove_repeats(spark, frame(spark, clashing=True).drop("n_bytes", "kept")).collect()
    texts = [(r["text"] or "").encode() for r in rows]
    for r, t, want in zip(rows, texts, brute_repeats(texts, 200)):
        assert bytes(r["kept"]) == want and r["n_bytes"] == len(t)
        spans = [(s["start"], s["end"]) for s in r["removed_spans"]]
        assert spans == sorted(spans) and all(a < b for a, b in spans) and len(t) - sum(b - a for a, b in spans) == len(want)
        assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
        assert r["key"] == "key"


@pytest.mark.parametrize("core", [193, 196, 260])
def test_repeats_around_one_core(spark, monkeypatch, core):
    """Many different rims around a common passage: one anchor, few pieces; some rims are alike."""
    from tidemill.llm import substrings

    monkeypatch.setattr(substrings, "HOT", 5)
    rng = np.random.default_rng(core)
    letters = "abcdefghijklmnopqrstuvwxyz "
    text = lambda n: "".join(letters[k] for k in rng.integers(0, len(letters), n))
    passage, rims = text(core), [(text(6), text(6)) for _ in range(6)]
    texts = [text(int(rng.integers(0, 40))) + a + passage + b + text(int(rng.integers(0, 40))) for k in range(40) for a, b in [rims[k % 6] if k % 3 == 0 else (text(6), text(6))]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = substrings.remove_repeats(spark, df).orderBy("doc_id").collect()
    assert [bytes(r["kept"]) for r in rows] == brute_repeats([t.encode() for t in texts], 200)


def test_suffix_array_with_small_memory():
    from tidemill.llm.induced import suffix_array

    rng = np.random.default_rng(1)
    for trial in range(60):
        n, s = int(rng.integers(1, 150)), int(rng.integers(2, 6))
        t = rng.integers(1, s, n)
        if trial % 3 == 0:
            t = np.concatenate([t, t[: n // 2], t])
        if trial % 5 == 0:
            t = np.repeat(t, rng.integers(1, 9, len(t)))
        t = np.concatenate([t, [0]]).astype(np.uint16)
        blocks = list(suffix_array(t, s + 1, 200, held=7, in_memory=int(rng.choice([3, 10_000]))))
        sa, lcp = np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks])
        plain = t.tolist()
        assert sorted(sa.tolist()) == list(range(len(t)))
        for k in range(1, len(sa)):
            a, b = plain[sa[k - 1] :], plain[sa[k] :]
            common = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert a[:200] <= b[:200] and lcp[k] == min(200, common)


# ------------------------------------------------------------- neighbours


def test_neighbours_find_nearly_all(spark):
    from tidemill.llm.neighbours import nearest

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 12))
    x = centres[rng.integers(0, 8, 900)] + 0.3 * rng.normal(size=(900, 12))
    x[100:140] = x[100]  # a group of copies
    bad = [(2000, None), (2001, [0.0] * 12), (2002, [float("nan")] + [1.0] * 11), (2003, [None] + [1.0] * 11), (2004, [1.0, 2.0]), (None, [1.0] * 12)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + bad
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = nearest(spark, df, df.where("vec_id % 20 = 0"), 10).collect()
    by = collections.defaultdict(dict)
    for r in found:
        by[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    queries = list(range(0, 900, 20))
    assert sorted(by) == queries
    hit = 0
    for q in queries:
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(900), -s))[:10]
        got = [by[q][k] for k in range(1, 11)]
        assert all(a[1] > b[1] or (a[1] == b[1] and a[0] < b[0]) for a, b in zip(got, got[1:]))
        assert all(abs(v - float(x[i] @ x[q])) < 1e-12 for i, v in got)
        hit += len({i for i, _ in got} & set(best.tolist()))
    assert hit >= 0.9 * 10 * len(queries)


def exact_neighbours(ids, x, queries, k):
    """Brute force: (query, rank) -> (key, score); ties to the smaller key."""
    out = {}
    for q, v in queries.items():
        s = (x * v).sum(1)
        own = [int(i) for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out.update({(q, r + 1): (int(ids[i]), float(s[i])) for r, i in enumerate(own)})
    return out


@pytest.mark.parametrize("n", [700, 2100])
def test_neighbours_with_a_tree_that_grows(spark, monkeypatch, n):
    """Several levels, blocks and query groups, a leaf of copies that won't come apart, repeated keys."""
    from tidemill.llm import neighbours as N

    for name, value in {"SAMPLE": 200, "BRANCHES": 4, "LEVELS": 1, "LEAF": 8, "LEAF_ROWS": 40, "LEAF_SAMPLE": 30, "BLOCK": 25, "QUERIES": 16, "GROUP_BYTES": 8 * 8 * 6}.items():
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(n)
    centres = 4 * rng.normal(size=(12, 8))
    x = centres[rng.integers(0, 12, n)] + 0.5 * rng.normal(size=(n, 8))
    x[n // 3 : 2 * n // 3] = x[n // 3]  # a third of all rows are copies
    ids = np.arange(n)
    ids[5], ids[6] = 4, 4  # a key that occurs three times, with three vectors
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 20 = 0 or vec_id = 4").union(df.where("vec_id = 20")).union(df.where("vec_id = 20"))
    queries = {int(i): min((x[j].tolist() for j in np.flatnonzero(ids == i))) for i in {*range(0, n, 20), 4}}
    want = exact_neighbours(ids, x, {q: np.array(v) for q, v in queries.items()}, 10)
    found = N.nearest(spark, df, asked, 10).collect()
    assert sorted((r["query_id"], r["rank"]) for r in found) == sorted(want)
    hit = sum(len({w[0] for (i, _), w in want.items() if i == q} & {r["vec_id"] for r in found if r["query_id"] == q}) for q in queries)
    assert hit >= 0.95 * sum(len({w[0] for (i, _), w in want.items() if i == q}) for q in queries)
    monkeypatch.setattr(N, "RECALL", 1.0)
    monkeypatch.setattr(N, "_calibrated", lambda *a: 1 << 30)  # all leaves: the search is exact
    for r in N.nearest(spark, df, asked, 10).collect():
        i, score = want[r["query_id"], r["rank"]]
        assert r["vec_id"] == i and abs(r["score"] - score) < 1e-12
    held = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{spark.conf.get('spark.checkpoint.dir')}")]
    names = [f.getPath().getName() for f in held[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(held[0])]
    assert not [x for x in names if x.startswith(("tidemill-leaves", "tidemill-visits"))]


def test_neighbours_of_few_rows_are_all_rows(spark):
    from tidemill.llm.neighbours import nearest

    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<float>")
    found = nearest(spark, df, df.where("vec_id % 20 = 0"), 20).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in found] == [(1, 1), (2, 2), (3, 3), (4, 4)]
    assert nearest(spark, df.limit(0), df, 3).count() == 0


# --------------------------------------------------------------- secrets


def test_secrets_and_links(spark):
    from tidemill.llm.secrets import KINDS, scan_secrets

    far, key40 = "x " * 400, "abcdEFGH0123" * 3 + "zzZ9"
    texts = [
        'é 日本 Password = "hunter2hunter2" and AKIA1234567890ABCD ' + "0123456789abcdef" * 2 + " done",
        "token=abc:secret=longvalue12 token=secret : longvalue123 apikey:short",
        "AKIA1234567890ABCD near " + key40,  # complementary: reported
        "AKIA1234567890ABCD " + far + key40,  # too far apart
        key40 + " alone https://example.com",
        "client_id=abcd1234 " + key40 + " https://example.com/x",
        None, "", "AKIA", "a" * 31,
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    found = scan_secrets(spark, spark.createDataFrame(rows, "doc_id long, text string"), "text").collect()
    assert len(found) == len(rows)
    kinds = lambda r, c: [KINDS[s["kind"]] for s in r[c]]
    by = {r["doc_id"]: r for r in found}
    assert kinds(by[0], "base_spans") == ["assign", "access", "hex"]
    for s in by[0]["base_spans"]:
        part = texts[0][s["start"] : s["end"]]
        assert part.startswith({"assign": "Password", "access": "AKIA", "hex": "0123"}[KINDS[s["kind"]]]) and not part.endswith(" ")
    pattern = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    want = [(m.start(), m.end()) for m in pattern.finditer(texts[1]) if len(m[2]) >= 8]
    assert [(s["start"], s["end"]) for s in by[1]["base_spans"]] == want
    assert kinds(by[2], "linked_spans") == ["secret"] and not by[3]["linked_spans"] and not by[4]["linked_spans"]
    assert kinds(by[5], "linked_spans") == ["identifier", "secret", "endpoint"]
    assert all(not by[i]["base_spans"] and by[i]["spans_text"] == "" for i in (6, 7, 8, 9))


def test_secrets_of_a_text_with_very_many(spark):
    """Half a million parts in two texts of megabytes; a scan that grows with their square would take hours."""
    from tidemill.llm.secrets import scan_secrets

    unit, full = "https://ab.cd token=abcdefghij ", "https://ab.cd token=abcdefghij AKIA1234567890ABCD "
    rows = [(1, unit * 100_000), (2, full * 60_000), (3, "token=" + "z" * 2_000_000), (4, unit + "x" * 300 + full)]
    found = {r["doc_id"]: r for r in scan_secrets(spark, spark.createDataFrame(rows, "doc_id long, text string"), "text").collect()}
    assert len(found[1]["base_spans"]) == 100_000 and not found[1]["linked_spans"]
    assert [tuple(s) for s in found[1]["base_spans"][-2:]] == [(len(unit) * k + 14, 0, len(unit) * k + 30) for k in (99_998, 99_999)]
    assert len(found[2]["base_spans"]) == 120_000 and len(found[2]["linked_spans"]) == 60_000
    assert found[3]["spans_text"] == "assign:0:2000006"
    at = len(unit) + 300
    assert found[4]["spans_text"] == f"assign:14:30,endpoint:{at}:{at + 13},assign:{at + 14}:{at + 30},access:{at + 31}:{at + 49}"


# ---------------------------------------------------------------- mixing


def test_mix_of_one_hot_key_many_sources_and_clashing_columns(spark):
    from tidemill.llm.mixing import mix

    rows = [(None, "big", 3) for _ in range(400)] + [(i, f"host{i:03d}", i % 7) for i in range(300)] + [(i, None, 5) for i in range(10)] + [(1, "none", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long").selectExpr("*", "7 as mix_taken", "8 as MIX_TARGET", "'x' as row", "1 as part")
    found = mix(spark, df, "doc_id", "source", "n", [5, 2, 1])
    assert found.columns == ["doc_id", "source", "n", "row", "part", "mix_source_size", "mix_target", "mix_taken"]
    by = collections.defaultdict(list)
    for r in found.collect():
        by[r["source"]].append(r)
    sizes = {s: sum(r["n"] or 0 for r in own) for s, own in by.items()}
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    level, total = 0.0, sum(sizes.values())  # by bisection
    low, high = 0.0, 3.0 * total
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(3 * sizes[s], level * weights[s]) for s in names) < total else (low, level)
    for s, own in by.items():
        assert all(r["mix_source_size"] == sizes[s] and abs(r["mix_target"] - min(3 * sizes[s], level * weights[s])) < 1e-6 for r in own)
        assert sum(r["mix_taken"] for r in own) == round(own[0]["mix_target"]) and all(r["mix_taken"] <= 3 * (r["n"] or 0) for r in own)
    assert mix(spark, df.limit(0), "doc_id", "source", "n", [5, 2, 1]).count() == 0



def test_mix_takes_each_sources_budget(spark):
    from pyspark.sql import functions as F

    from tidemill.llm.mixing import mix, word_count

    df = frame(spark, clashing=True).drop("mix_taken", "size").withColumn("size", word_count(F.col("text")))
    rows = mix(spark, df, "doc_id", "source", "size", [5, 2, 1]).collect()
    assert len(rows) == len(corpus())
    by = collections.defaultdict(list)
    for r in rows:
        assert r["size"] == len(SPACE.findall(r["text"] or "")) and 0 <= r["mix_taken"] <= 3 * r["size"]
        by[r["source"]].append(r)
    total = sum(r["size"] for r in rows)
    sizes = {s: sum(r["size"] for r in v) for s, v in by.items()}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: [5, 2, 1][i % 3] for i, s in enumerate(order)}
    target, fixed = {}, {}
    while True:  # share, stop what is above, share the rest again
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        target = fixed | {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if target[s] > 3 * sizes[s]]
        if not above:
            break
        fixed |= {s: 3 * sizes[s] for s in above}
    for s, v in by.items():
        assert all(abs(r["mix_target"] - target[s]) < 1e-6 for r in v)
        assert abs(sum(r["mix_taken"] for r in v) - target[s]) <= 0.5


# ------------------------------------------------------------------ WARC


def test_archives_round_trip(spark, tmp_path, monkeypatch):
    from tidemill.llm import warc

    monkeypatch.setattr(warc, "SHARD_BYTES", 4000)
    monkeypatch.setattr(warc, "ROLL_BYTES", 900)
    pages = [(i, f"http://h/{i}", f"<p>{'word ' * (i % 7) * 20}</p>") for i in range(60)]
    pages += [(100, None, None), (101, "u\r\nx", ""), (7, "again", pages[7][2]), (None, "n", "<p></p>"), (102, "long", "z" * 50_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    out = warc.write_warc(spark, df, f"file://{tmp_path}/a")
    rows = warc.read_warc(spark, out).collect()
    assert len(rows) == len(pages)
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", 1 << 60), i)
    html = {i: h or "" for i, _, h in pages}
    for r in rows:
        h = html[r["page_id"]]
        assert r["payload_bytes"] == len(h.encode()) and r["payload_digest"] == warc.digest(h.encode())
        want = first.get(h)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if want == r["page_id"] else ("revisit", want))
        assert r["record_type"] == "revisit" or bytes(r["payload"]) == h.encode()
    assert sum(r["url"] is None for r in rows) == 1 and sum(r["url"] == "u\r\nx" for r in rows) == 1
    again = warc.write_warc(spark, df.repartition(2), f"file://{tmp_path}/b")
    files = lambda p: {f.name: f.read_bytes() for f in p.glob("*.warc.gz")}
    assert files(tmp_path / "a") == files(tmp_path / "b") and len(files(tmp_path / "a")) > 3 and again
    assert not list((tmp_path / "a").glob("_temporary*"))


def test_a_key_of_very_many_records_takes_several_shards(spark, tmp_path, monkeypatch):
    from tidemill.llm import common, warc

    monkeypatch.setattr(warc, "SHARD_BYTES", 3000)
    monkeypatch.setattr(common, "HOT_KEYS", 1)  # the key of most copies goes by broadcast
    pages = [(None, f"u{i}", "a" * 100) for i in range(120)] + [(None, f"v{i}", f"{i}" * 50) for i in range(60)]
    pages += [(5, f"w{i}%\n%0A", "a" * 100) for i in range(50)] + [(6, "x", "b" * 100), (9, "x", "b" * 100)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    out = warc.write_warc(spark, df, f"file://{tmp_path}/a")
    rows = warc.read_warc(spark, out).collect()
    assert collections.Counter((r["page_id"], r["url"]) for r in rows) == collections.Counter(p[:2] for p in pages)
    kinds = collections.Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in rows if r["payload_bytes"] == 100 and not (r["url"] or "").startswith("v"))
    assert kinds == {(None, "revisit", 5): 120, (5, "response", None): 50, (6, "response", None): 1, (9, "revisit", 6): 1}
    held = collections.Counter(r["file"].split("-")[1] for r in rows if r["page_id"] is None)
    assert len(held) > 4 and max(held.values()) < 60
    ids = []
    for f in (tmp_path / "a").glob("*.warc.gz"):
        with f.open("rb") as stream:
            ids += [re.search(rb"WARC-Record-ID: (\S+)", raw)[1] for _, raw in warc.members(stream)]
    assert len(ids) == len(set(ids)) == len(pages)


def test_damaged_records_are_found():
    from tidemill.llm.warc import parsed, record

    raw = record(1, "u", b"payload", None, 0)
    assert parsed(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        parsed(raw.replace(b"payload\r\n\r\n", b"paYload\r\n\r\n"))


# --------------------------------------------------------------- Jaccard


def shingles(text):
    w = SPACE.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_groups(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), 1 << 60), k)
    return sorted((-1 if k is None else k, len(sets[i]), -1 if (low := least.get(find(i), k)) is None else low) for i, (k, _) in enumerate(rows))


@pytest.mark.parametrize("batch", [3, 4000])
def test_shared_elements_are_counted_exactly(spark, batch):
    """Against brute force: an element of all sets, elements of two batches, sets that lie in one batch several times."""
    from tidemill.llm import jaccard as J

    rng = np.random.default_rng(batch)
    common = rng.integers(0, 2**63, 6, dtype=np.uint64)
    sets = [np.unique(np.concatenate([common[:1], rng.choice(common, 2), rng.integers(0, 2**63, 12, dtype=np.uint64)])) for _ in range(40)]
    sets[1] = np.unique(np.concatenate([sets[0][:9], sets[1]]))
    batches = [sets[i : i + batch] for i in range(0, 40, batch)]
    batches[0] = batches[0] + batches[0][:1]  # a copy within the batch
    rows = []
    for part in batches:
        for b in J._packed(part, [J.identity(x) for x in part], 16, 5):
            rows += b.to_pylist()
    packed = spark.createDataFrame([(r["slice"], r["elements"], r["places"], r["sids"]) for r in rows], J._PACKED)
    got = {bytes(r["sid"]): r["shared"] for r in J._shared(packed, 5).collect()}
    times = collections.Counter(x for s in sets for x in s.tolist())
    assert got == {J.identity(s): n for s in sets if (n := sum(times[x] > 1 for x in s.tolist()))}
    entries = sum(len(r["elements"]) // 4 for r in rows if r["slice"] >= 0)
    assert entries == sum(len({x for s in part for x in s.tolist()}) for part in batches)  # an element is one entry a batch


def test_similar_sets_take_little_disk(spark, monkeypatch):
    """In many slices an element brings its set's short name at most; a step's shuffle files go when it has ended."""
    import glob

    from tidemill.llm import jaccard as J

    root = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()[0].getPath()
    shuffles = lambda: set(glob.glob(f"{root}/**/shuffle_*.data", recursive=True))
    before, names, left = shuffles(), [], []

    def shared(packed, *more, real=J._shared):
        r = packed.where("slice >= 0").selectExpr("sum(octet_length(sids)) / sum(octet_length(elements)) * 4 x").first()
        names.append(r["x"])
        left.append(shuffles() - before)
        return real(packed, *more)

    def members(keys, real=J._members):
        left.append(shuffles() - before)
        return real(keys)

    monkeypatch.setattr(J, "_shared", shared)
    monkeypatch.setattr(J, "_members", members)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        rows = [(i, " ".join(f"w{i // 2}x{k}" for k in range(30)) + f" end{i}", None, None, 0) for i in range(40)]
        found = J.similar_groups(spark, frame(spark, rows)).collect()
        assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(i, i - i % 2) for i in range(40)}
    assert len(names) == 2 and max(names) <= 8
    # those of the counts that the test itself has made, at most
    assert len(left) == 3 and all(len(x) <= 2 for x in left)


def test_links_join_stars_and_chains(spark):
    from tidemill.llm import jaccard as J

    rng = np.random.default_rng(4)
    ids = rng.permutation(700).tolist()
    pairs = [(ids[0], x) for x in ids[1:400]] + list(zip(ids[400:460], ids[401:461])) + [(ids[460 + k], ids[460 + k // 2]) for k in range(1, 120)] + [(ids[0], ids[1])] * 3
    found = {r["x"]: r["root"] for r in J._joined(spark, None, spark.createDataFrame(pairs, "a long, b long")).collect()}
    groups = [ids[:400], ids[400:461], ids[461:580] + [ids[460]]]
    groups[1:] = [ids[400:580]]  # the chain's end is the tree's root
    assert found == {x: min(g) for g in groups for x in g if x != min(g)}


def test_groups_with_a_passage_in_all_texts_and_a_chain(spark, monkeypatch):
    """Every text holds the same passage; neighbours of a chain are alike, its ends are not; others meet keys and aren't alike."""
    from tidemill.llm import common, jaccard

    monkeypatch.setattr(jaccard, "BLOCK_SETS", 3)
    monkeypatch.setattr(jaccard, "COSTED", 8)
    monkeypatch.setattr(common, "HOT_KEYS", 1)
    rng = np.random.default_rng(8)
    passage = "this very passage stands in all of the texts of the table".split()
    words = [f"w{k}" for k in range(3000)]
    chain = rng.choice(words, 160).tolist()
    rows = []
    for k in range(12):  # each changes eight words of the one before
        rows.append((100 + k, " ".join(passage + chain)))
        for j in range(8):
            chain[(k * 13 + j) % 160] = f"c{k}-{j}"
    half = rng.choice(words, 30).tolist()
    rows += [(200 + k, " ".join(passage + half + rng.choice(words, 30).tolist())) for k in range(20)]  # a third in common: no link
    rows += [(300 + k, " ".join(passage + rng.choice(words, 50).tolist())) for k in range(30)] + [(1000 + k, rows[0][1]) for k in range(40)]
    found = {r["doc_id"]: r["component_id"] for r in jaccard.similar_groups(spark, frame(spark, [(i, t, None, None, 0) for i, t in rows])).collect()}
    sets = {i: {tuple(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4)} for i, t in rows}
    root = {i: i for i, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in root:
        for j in root:
            if i < j and 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    assert found == {i: top(i) for i in root} and found[111] == 100 and found[200] == 200


@pytest.mark.parametrize("seed", [7, 8])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, seed):
    from tidemill.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK_SETS", 4)
    rows = corpus(seed)
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 5000, 160)]
    for k in range(70):  # a family around the threshold, and small sets
        words = list(base)
        for at in rng.integers(0, 160, int(rng.integers(1, 8))):
            words[at] = f"x{rng.integers(0, 10**6)}"
        rows.append((1000 + k, " ".join(words), "en", "src0", 0))
        short = list(base[: int(rng.integers(4, 14))])
        if k % 3:
            short[-1] = f"y{k % 5}"
        rows.append((2000 + k, " ".join(short), "en", "src0", 0))
    found = jaccard.similar_groups(spark, frame(spark, rows, clashing=True)).collect()
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in found)
    assert got == brute_groups([(r[0], r[1]) for r in rows])


def test_every_similar_pair_meets_in_a_key():
    """The pigeonhole, pair by pair: similar sets share a key that is whole for one of them."""
    from tidemill.llm import jaccard as J

    rng = np.random.default_rng(0)
    for trial in range(300):
        n = int(rng.integers(1, 120))
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        gone = int(rng.integers(0, len(x) // 4 + 1))
        extra = int(rng.integers(0, len(x) // 4 + 1))
        y = np.unique(np.concatenate([x[gone:], rng.integers(0, 2**63, extra, dtype=np.uint64)]))
        common = len(np.intersect1d(x, y))
        if not len(y) or 4 * common < 3 * (len(x) + len(y) - common):
            continue
        ranges = J.bands(400)
        lows = np.array([r[0] for r in ranges])
        keys = []
        for s in (x, y):
            own = int(np.searchsorted(lows, len(s), side="right")) - 1
            got = {}
            for band in (own, own - 1)[: 1 + (own > 0)]:
                high = ranges[band][1]
                k, w = J.keys_of(s, band, high, J.numbers(high, np.random.default_rng(band).random(J.segment_count(high))))
                for a, b in zip(k.tolist(), w.tolist()):
                    got[a] = got.get(a, False) or b
            keys.append(got)
        assert any(keys[0][k] or keys[1][k] for k in keys[0].keys() & keys[1].keys()), (len(x), len(y), common)


# ------------------------------------------------------------- token ids


def test_token_files_round_trip(spark, tmp_path, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidemill.llm import token_output as out

    monkeypatch.setattr(out, "SHARD_IDS", 500)
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = corpus() + [(500, "x<|endoftext|>y <|EndOfText|>. a..b, c,. İ H̱ don't 12.", "en", None, 0)]
    files = out.write_ids(spark, frame(spark, rows, clashing=True), f"file://{tmp_path}/ids", path)
    found = out.read_ids(spark, files).collect()
    plain = Tokenizer.from_file(path)
    want = collections.Counter((r[0], tuple(plain.encode(r[1] or "", add_special_tokens=False).ids) + (2,)) for r in rows)
    assert collections.Counter((r["key"], tuple(r["ids"])) for r in found) == want
    start, last = 0, (False, 0)
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == start and last <= (r["key"] is not None, r["key"] or 0)
        start, last = start + len(r["ids"]), (r["key"] is not None, r["key"] or 0)
    assert len(list((tmp_path / "ids").glob("ids-*.rans"))) > 2


def test_cached_pieces_encode_as_whole_texts_do():
    import random

    import public_tokenizers

    from tidemill.llm.token_output import Encoder

    enc, rng = Encoder(public_tokenizers.path("word_bpe_49k.json")), random.Random(1)
    assert enc.apart
    signs = "abzAZéÉßÿÀ×÷ªµ0129.,;:'\"!?-_#%&*()<>|@$~^`\\/[]{} \n\t 日本İı\u0301ẞ’“”–…½²"
    pools = [signs, signs, [chr(i) for i in range(0xA0)], "\u00a0\u1680\u2003\u2028\u2029\u202f\u205f\u3000\u200b\ufeff", [chr(i) for i in range(0x300, 0x370)], ["<|endoftext|>", "<|EndOfText|>", "'s", "'LL"], "ab., "]
    fixed = ["", "|.", "a. b, c.", "<|endoftext|>", "don't", "\x1f.", "=\x11\t\x17KF(…\x1e,", "a,\x1c b.\x1d", "a.\n\nB,"]
    texts = fixed + ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(1, 40))) for _ in range(20_000)]
    got = [x.as_py() for k in range(0, len(texts), 500) for x in enc.encoded(pa.array(texts[k : k + 500]))]
    for text, ids in zip(texts, got):
        assert ids == enc.plain(text).tobytes(), text
    assert enc.encoded(pa.array([None, "a"], pa.string())).to_pylist() == [b"", enc.plain("a").tobytes()]
    assert len(enc.encoded(pa.array([], pa.string()))) == 0
    enc.apart = False
    assert [x.as_py() for x in enc.encoded(pa.array(texts[:300]))] == got[:300]


def test_tokenizers_that_do_not_come_apart_get_whole_texts(tmp_path):
    import json

    import public_tokenizers

    from tidemill.llm.token_output import Encoder, apart

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    assert apart(spec)
    for part, key, value in (("normalizer", None, {"type": "NFKD"}), ("pre_tokenizer", None, {"type": "Whitespace"}), ("model", "end_of_word_suffix", None), ("added_tokens", 0, spec["added_tokens"][0] | {"lstrip": True})):
        other = json.loads(json.dumps(spec))
        if key is None:
            other[part] = value
        else:
            other[part][key] = value
        assert not apart(other), part
    bytewise = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not bytewise.apart and bytewise.ids("Ab  c. d") == bytewise.plain("Ab  c. d").tobytes()


def test_neighbouring_shards_share_a_task(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tidemill.llm import common

    rows = spark.range(40).select((F.col("id") % 10).alias("shard"))
    for most, tasks in ((20_000, 10), (4, 4)):
        monkeypatch.setattr(common, "MOST_TASKS", most)
        dealt = common.by_shard(rows, 10).select(F.spark_partition_id().alias("p"), "shard").distinct().collect()
        assert {r["p"] for r in dealt} == set(range(tasks)) and sorted((r["shard"], r["p"]) for r in dealt) == [(s, s * tasks // 10) for s in range(10)]
    assert common.by_shard(rows.limit(0), 0).collect() == []


def test_blocks_decode_alone_and_damage_shows(tmp_path):
    import pyarrow.fs as pafs

    from tidemill.llm import token_output as out

    rng = np.random.default_rng(0)
    ids = np.minimum(rng.geometric(0.01, 700_000), 4999).astype(np.uint32)
    table = out.Table(out.scaled(np.bincount(ids, minlength=5000)))
    assert int(table.freq.sum()) == 1 << out.SCALE
    for n in (1, 5, out.LANES, out.LANES + 1, 100_001):
        assert (out.decode_block(out.encode_block(ids[:n], table), n, table) == ids[:n]).all()
    w = out._Writer(f"file://{tmp_path}", 0, 10, table)
    w.add(1, False, ids[:-1], 2)
    w.closed()
    f = out.ShardFile(str(tmp_path), "ids-00000000.rans", pafs.LocalFileSystem(), table)
    assert len(f.foot["blocks"]) == 3 and (f.ids(300_000, 1000) == ids[300_000:301_000]).all()
    raw = bytearray((tmp_path / "ids-00000000.rans").read_bytes())
    raw[f.foot["blocks"][1][0] + 9] ^= 1
    (tmp_path / "ids-00000000.rans").write_bytes(raw)
    f = out.ShardFile(str(tmp_path), "ids-00000000.rans", pafs.LocalFileSystem(), table)
    assert len(f.block(0)) == out.BLOCK
    with pytest.raises(ValueError):
        f.block(1)


# -------------------------------------------------------- decontamination


def brute_windows(text, items):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    words, hit, have = low(text), set(), set()
    for i, t in items:
        w = low(t)
        n = min(10, len(w))
        if not n:
            continue
        own = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for k in range(len(words) - n + 1):
            if tuple(words[k : k + n]) in own:
                hit.update(range(k, k + n))
                have.add(None if i is None else str(i))
    return len(words), sorted(hit), sorted(have, key=lambda i: (i is None, i))


@pytest.mark.parametrize("most,bits", [(1 << 20, 1 << 28), (10, 1 << 28), (10, 0)])
def test_windows_as_by_brute_force(spark, monkeypatch, most, bits):
    """By a broadcast table, by a join behind a filter, and by a join without one."""
    from tidemill.llm import decontamination as D

    monkeypatch.setattr(D, "MOST_WINDOWS", most)
    monkeypatch.setattr(D, "FILTER_BITS", bits)
    rows = corpus()
    passage = rows[-8][1].split(" ")
    items = [(10, " ".join(rows[40][1].split(" ")[:14])), (9, "ALPHA; beta: gamma"), (2, None), (None, "alpha"), (None, "theta iota"), (3, ""), (4, " ".join(passage[5:17]).upper()), (4, " ".join(passage[5:17]).upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = D.find_contamination(spark, frame(spark, clashing=True), bench).collect()
    assert len(found) == len(rows)
    for r in found:
        n, hit, have = brute_windows(r["text"], items)
        assert r["n_words"] == n and [k for s in r["hit_spans"] for k in range(s["start"], s["end"])] == hit and r["hit_items"] == have
    clean = D.decontaminated(spark, frame(spark), bench).collect()
    assert sorted(r["text"] or "" for r in clean) == sorted(r["text"] or "" for r in found if not r["hit_spans"])
    cut = D.decontaminated(spark, frame(spark), bench, action="spans").collect()
    assert len(cut) == len(rows)
    assert all(not brute_windows(r["text"], [items[1]])[1] for r in cut if "gamma" not in (r["text"] or "").lower()[:40])


# --------------------------------------------------------------- toxicity


def test_gradients_are_those_of_the_risk():
    from tidemill.llm import toxicity as X

    rng = np.random.default_rng(2)
    seen = set()
    for shift in (-2.0, 0.0, 3.0):
        fp, fu = rng.normal(size=7) + shift, rng.normal(size=11) - shift
        plain = lambda a, b: sum(0.3 * np.log1p(np.exp(-x)) for x in a) / 7 + max(0, sum(np.log1p(np.exp(x)) for x in b) / 11 - 0.3 * sum(np.log1p(np.exp(x)) for x in a) / 7)
        assert abs(X.risk(fp, fu, 0.3) - plain(fp, fu)) < 1e-12
        low = X.excess(fp, fu, 0.3) < 0
        seen.add(low)
        of = (lambda a, b: -X.excess(a, b, 0.3)) if low else (lambda a, b: X.risk(a, b, 0.3))
        for one, g in zip((0, 1), X.gradients(fp, fu, 0.3)):
            for k in range(len(g)):
                up, down = [fp.copy(), fu.copy()], [fp.copy(), fu.copy()]
                up[one][k] += 1e-6
                down[one][k] -= 1e-6
                assert abs((of(*up) - of(*down)) / 2e-6 - g[k]) < 1e-6
    assert seen == {True, False}


def test_a_fit_draws_on_bounded_rows(spark, monkeypatch):
    """Repeated ids bring one text, long texts their most telling features; scores stay right."""
    from tidemill.llm import toxicity as X

    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(400)]
    text = lambda i: " ".join(rng.choice(words, 40)) + (" vile scum rotten" if i % 6 == 0 else "")
    rows = [(i, text(i)) for i in range(900)] + [(6, "vile scum rotten " + " ".join(words) * 5)] + [(0, f"vile scum {k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(0, 900, 2)], "doc_id long, toxic int")
    monkeypatch.setattr(X, "MOST_FEATURES", 6)
    found = X.score_toxicity(spark, docs, labels).collect()
    held = [r for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and r["doc_id"] not in (0, 6)]
    assert len(found) == len(rows) and np.mean([r["tox_predicted"] == int(r["doc_id"] % 6 == 0) for r in held]) > 0.97


def test_toxicity_is_learnt_from_the_open_folds(spark):
    from tidemill.llm.toxicity import CUT, score_toxicity

    rng = np.random.default_rng(5)
    rude = ["vile", "rotten", "wretch", "foul", "nasty"]
    rows, labels = [], []
    for i in range(1500):
        words = [f"w{k}" for k in rng.integers(0, 400, 40)]
        toxic = i % 9 == 0
        if toxic:
            words[::6] = [rude[k] for k in rng.integers(0, 5, 7)]
        rows.append((i, " ".join(words), "en", "src0", 0))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    rows += [(5000, None, None, None, None), (5001, "", None, None, 0), (None, "w1 w2", None, None, 0), (0, rows[0][1], None, None, 0)]
    marks = spark.createDataFrame([*labels, (7777, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    df = frame(spark, rows, clashing=True)
    found = score_toxicity(spark, df, marks).collect()
    assert len(found) == len(rows) and all(0 <= r["tox_score"] <= 1 and r["tox_predicted"] == int(r["tox_score"] >= CUT) for r in found)
    held = [r for r in found if r["doc_id"] is not None and r["doc_id"] < 1500 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert np.mean([r["tox_predicted"] == int(r["doc_id"] % 9 == 0) for r in held]) > 0.97
    flipped = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels], "doc_id long, toxic int")
    again = score_toxicity(spark, df, flipped.union(spark.createDataFrame([(7777, 1)], "doc_id long, toxic int"))).collect()
    key = lambda r: (r["doc_id"] or -1, r["text"] or "", r["tox_score"])
    assert sorted(map(key, found)) == sorted(map(key, again))  # labels of the held-out fold change nothing
    none = score_toxicity(spark, df, marks.limit(0)).collect()
    assert all(r["tox_score"] == 0 and r["tox_predicted"] == 0 for r in none)


# --------------------------------------------------------- empty and pipeline


def test_empty_tables(spark, tmp_path):
    import public_tokenizers
    from pyspark.sql import functions as F

    from tidemill.llm import decontamination, jaccard, mixing, secrets, sharding, substrings, token_output, toxicity, warc

    docs = frame(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert sharding.feistel_shards(spark, docs, ["doc_id"], 5).count() == 0
    assert substrings.remove_repeats(spark, docs).count() == 0
    assert secrets.scan_secrets(spark, docs, "text").count() == 0
    assert mixing.mix(spark, docs.withColumn("size", F.length("text")), "doc_id", "source", "size", [5, 2, 1]).count() == 0
    assert warc.read_warc(spark, warc.write_warc(spark, pages, f"file://{tmp_path}/w")).count() == 0
    assert jaccard.similar_groups(spark, docs).count() == 0
    assert token_output.read_ids(spark, token_output.write_ids(spark, docs, f"file://{tmp_path}/t", public_tokenizers.path("word_bpe_49k.json"))).count() == 0
    assert decontamination.find_contamination(spark, docs, bench).count() == 0
    assert decontamination.decontaminated(spark, frame(spark), bench).count() == len(corpus())
    assert toxicity.score_toxicity(spark, docs, labels).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    rows = corpus()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, rows[20][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == P.COLUMNS
        kept.append([tuple(r) for r in docs.collect()])
    toxicity, near, clean, mixed = kept
    assert sorted(map(repr, toxicity)) == sorted(repr(tuple(r)) for r in rows)  # nothing to learn from: all stay
    groups = brute_groups([(r[0], r[1]) for r in rows])
    with_words = {g[2] for g in groups if g[1]}
    assert {(-1 if r[0] is None else r[0]) for r in near if shingles(r[1])} == with_words and len([r for r in near if shingles(r[1])]) == len(with_words)
    assert len([r for r in near if not shingles(r[1])]) == len([r for r in rows if not shingles(r[1])])
    assert {repr(r) for r in near} - {repr(r) for r in clean} == {repr(r) for r in near if brute_windows(r[1], [(1, rows[20][1])])[1]}
    size = lambda t: len(SPACE.findall(t or ""))
    whole = {r[0]: size(r[1]) for r in clean}
    taken = collections.Counter()
    for r in mixed:
        taken[r[0]] += size(r[1])
        assert size(r[1]) <= whole[r[0]]
    assert all(v <= 3 * whole[k] for k, v in taken.items()) and abs(sum(taken.values()) - sum(whole.values())) <= 5
    last = P.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(last) == len(mixed) and {r["doc_id"] for r in last} == {r[0] for r in mixed}
    assert hashlib.sha256(b"").hexdigest() and fixtures.CLASHING == CLASHING
