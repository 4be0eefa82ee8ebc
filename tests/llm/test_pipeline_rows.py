"""Stages of the pipeline on rows whose doc_id is null or repeated."""

import collections

from .fixtures import frame


def words(name, n=40):
    return " ".join(f"{name}{i}" for i in range(n))


def test_one_row_of_each_group_whatever_its_key(spark, tmp_path):
    import corpus_pipeline as P

    rows = [(None, words(f"n{i}"), "en", "src0", 0) for i in range(4)]  # unrelated texts without a key
    rows += [(None, words("n0"), "en", "src1", 0), (None, words("n1") + " end", "en", "src0", 0)]  # copies of two of them
    rows += [(1, words("a"), "en", "src0", 0), (1, words("b"), "en", "src0", 0)]  # two groups of the same smallest key
    rows += [(2, words("a"), "en", "src0", 0), (None, words("b"), "en", "src0", 0)]
    rows += [(3, words("c"), "en", "src0", 0), (3, words("c"), "en", "src0", 0), (4, words("c"), "de", "src0", 0)]  # equal rows
    rows += [(None, None, None, "src0", None), (None, " ", "en", "src0", 1), (3, "", "en", "src0", 0)]
    got = collections.Counter(tuple(r) for r in P.near_duplicates(spark, frame(spark, rows), str(tmp_path)).collect())
    want = [rows[0], rows[1], rows[2], rows[3], rows[6], rows[7], rows[10], *rows[13:]]
    assert got == collections.Counter(want)


def test_each_row_of_a_shared_key_gets_its_own_take(spark, tmp_path):
    import corpus_pipeline as P

    def rows_of(source, key, n):
        return [(key, words(f"{source}x{i}_", 10), "en", source, 0) for i in range(n)]

    # 120 rows a source weighing 5, 2 and 1: the last two have targets of 900 and 450 words, under their 1,200
    rows = rows_of("a", None, 120) + rows_of("b", None, 119) + [(None, words("bx0_", 10), "en", "b", 0)]  # two rows are equal
    rows += rows_of("c", 7, 117) + [(8, words("same", 10), "en", "c", 0)] * 3
    texts = {r[1] for r in rows}
    per_source = collections.defaultdict(list)
    for r in P.mixing(spark, frame(spark, rows), str(tmp_path)).collect():
        per_source[r["source"]].append(r["text"])
    for source, want in (("a", 2250), ("b", 900), ("c", 450)):
        sizes = [len(t.split()) for t in per_source[source]]
        assert sum(sizes) == want  # the budget to the word
        assert len([t for t in per_source[source] if t not in texts]) <= 1  # one text at most is cut short


def test_texts_reach_workers_in_small_batches(spark, monkeypatch, tmp_path):
    """Whole texts go to Python in batches of TEXT_ROWS rows, and the session's setting comes back."""
    import corpus_pipeline as P
    from tidemill.llm import common, jaccard, token_output

    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", {}
    before = spark.conf.get(name)

    def written(spark, df, what, real=common.written):
        seen[what] = int(spark.conf.get(name))
        return real(spark, df, what)

    monkeypatch.setattr(jaccard, "written", written)
    monkeypatch.setattr(token_output, "written", written)
    rows = [(i, words(f"t{i // 2}x"), "en", "src0", 0) for i in range(6)]
    assert P.near_duplicates(spark, frame(spark, rows), str(tmp_path)).count() == 3
    assert P.token_ids(spark, frame(spark, rows), str(tmp_path)).count() == 6
    assert {k: seen[k] for k in ("sizes", "sets", "counts")} == dict.fromkeys(("sizes", "sets", "counts"), common.TEXT_ROWS)
    assert spark.conf.get(name) == before and common.TEXT_ROWS < 10_000
    assert list(common.tidied(lambda batches: (2 * b for b in batches))([1, 2])) == [2, 4]
