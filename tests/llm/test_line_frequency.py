from __future__ import annotations

import importlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fernwalk.llm import line_frequency as L
from fernwalk.llm import oracles
from fernwalk.llm.common import table
from tests import parity
from tests.llm.conftest import clash, rows

DOCS = "doc_id long, text string, source string"
WORD = r"[^\x20\x09-\x0D]+"


def plain(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def check(spark, texts):
    got = {r.doc_id: r for r in L.quality(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(t), repr(t)


def test_base_counts_are_the_contracts(spark):
    seen = []

    @settings(max_examples=250, deadline=None, database=None)
    @given(st.lists(st.sampled_from(["a", "b", "cé", "#", "|x", "\n", "\t", "\x0b", "\x0c", "\r", "\x85", " ", "🎉"]), max_size=60).map(" ".join))
    def gather(text):
        seen.append(text)

    gather()
    long = " ".join("a b c d e f g h i j k".split() * 40)
    check(spark, [*seen, None, "", "a b c d e f g h", "a b c d e f g h a b c d e f g h", long, "a a a a a a a a a", "x y\n" * 30])


def test_lines_in_many_documents_go(spark):
    own = lambda i: "\n".join(" ".join(f"w{i}{k}{j}" for j in range(12)) for k in range(4))
    data = [(i, f"Shared  LINE of the\thost\n{own(i)}\nShare", "a") for i in range(6)]
    data += [(10 + i, "shared line of the host\n" * 9 + f"just one own line here u{i}", "a") for i in range(3)]
    data += [(20, "shared line of the host\n" + own(20), "b"), (21, own(21) + "\nu1 u2 u3 u4", None)]
    df = spark.createDataFrame(data, DOCS)
    got = {r.doc_id: r for r in L.quality(df, min_docs=6, max_share=2).collect()}
    assert got[0].n_removed_words == 6
    assert got[0].kept
    assert got[10].n_removed_words == 45
    assert not got[10].kept
    assert got[20].n_removed_words == got[21].n_removed_words == 0
    assert {r.n_removed_words for r in L.quality(df, min_docs=10, max_share=2).collect()} == {0}
    assert {r.n_removed_words for r in L.quality(df, min_docs=7, max_share=2).collect()} == {0, 5, 45}


def frequent(df, **limits):
    return L.frequent_lines(L.base_columns(df), **limits).collect()


def test_share_and_number(spark):
    data = [(i, "one two three four\n" * (i < 30) + f"own words {i} " * 20, "a") for i in range(400)]
    df = spark.createDataFrame(data, DOCS)
    assert frequent(df, max_share=13) == []
    assert len(frequent(df, max_share=14)) == 1
    assert frequent(df, max_share=1, max_docs=30) == []
    assert len(frequent(df, max_share=1, max_docs=29)) == 1


def test_a_row_counts_a_line_once(spark):
    df = spark.createDataFrame([(1, "one two three\n" * 50, "a")], DOCS)
    assert frequent(df, min_docs=2) == []


def test_many_frequent_lines_are_joined_without_broadcast(spark, monkeypatch):
    data = [(i, "one two three four\n" + f"own words {i} " * 20, f"s{i % 2}") for i in range(40)]
    df = spark.createDataFrame(data, DOCS)
    want = rows(L.quality(df))
    monkeypatch.setattr(L, "checked_broadcast", lambda x: x)
    assert rows(L.quality(df)) == want
    assert {r[-1] for r in want} == {4}


def test_odd_rows(spark, odd, none):
    got = rows(L.quality(odd))
    assert got == rows(L.quality(clash(odd)))
    assert len(got) == 9
    assert L.quality(none).collect() == []


def test_the_plan_holds_no_python(odd):
    plan = L.quality(odd)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_removed_lines_are_the_sqls(spark, tmp_path, monkeypatch):
    """Hosts in which the least number, the share, and the largest number decide, with lines at and past each limit."""
    monkeypatch.setattr(L, "MAX_DOCS", 200)
    own = " ".join(f"w{j}" for j in range(24))
    data = [(i, ("Seen  in two\n" * (i < 2) + "seen in three\n" * (i < 3)) * 9 + f"{own} u{i}", "a") for i in range(5)]
    data += [(1000 + i, "one in twenty\n" * (i < 5) + "more than that\nShare\n" * (i < 6) + f"{own} {i}", None if i % 2 else "b") for i in range(200)]
    data += [(10_000 + i, "as many as may be\n" * (i < 200) + "one more\n" * (i < 201) + f"u{i}", "c") for i in range(5000)]
    spark.createDataFrame(data, DOCS).write.parquet(str(tmp_path / "made"))
    spark.read.parquet(str(tmp_path / "made")).coalesce(1).write.parquet(str(tmp_path / "one"))
    next((tmp_path / "one").glob("part-*.parquet")).rename(tmp_path / "documents.parquet")
    monkeypatch.setattr(parity, "SF", tmp_path)
    sql = importlib.reload(oracles).OP4
    parity.same_rows(spark, lambda s, d: L.quality(table(s, d, "documents"), max_docs=200), sql)
    removed = {r.doc_id: r.n_removed_words for r in L.quality(spark.read.parquet(str(tmp_path / "documents.parquet")), max_docs=200).collect()}
    assert [removed[0], removed[2], removed[3], removed[10_000], removed[10_200], removed[10_201]] == [27, 27, 0, 2, 2, 0]
    monkeypatch.undo()
    importlib.reload(oracles)


@parity.needs_data
@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_lines_are_removed_from_the_tables(spark, scale):
    """The method acts on small hosts too, and leaves most documents alone."""
    got = L.quality(table(spark, f"/root/testdata/{scale}", "documents")).agg(
        F.count("*").alias("n"), F.count_if(F.col("n_removed_words") > 0).alias("hit"), F.count_if(~F.col("base_failed") & ~F.col("kept")).alias("depleted")
    ).first()
    assert got.hit > 0
    assert got.depleted < got.n / 10
    assert got.depleted > 0 or scale == "sf0.001"
