from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fernwalk.llm import toxicity as X
from fernwalk.llm.common import table
from tests.llm.test_near_groups import plain_groups


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables in which it is known what each stage has to do."""
    out = str(tmp_path_factory.mktemp("tables"))
    r = random.Random(11)
    word = lambda: "".join(r.choice("bdfgklmprt") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    docs, labels = [], []
    for i in range(400):
        t = text(r.randint(40, 120))
        if i % 5 == 0:
            words = t.split()
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(X.SEED_TERMS))
            t = " ".join(words)
        labels.append((i, 1, int(i % 5 == 0)))
        docs.append([i, t, "en", f"s{i % 4}", None])
    item = "the measured distance between both stations was eleven miles by road"
    docs[1][1] += " " + item + " " + text(5)
    docs[2][1] += " " + item.replace("eleven", "elevn") + " " + text(5)
    docs[6][1] = docs[3][1]
    docs[7][1] = docs[3][1].upper()
    docs[8][1] += ' token = "0123456789abcdef0123456789abcdef01234567" ' + text(3)
    docs += [[900, None, None, None, None], [901, "", "en", None, 0], [None, text(30), "en", "s1", None], [950, text(60_000), "en", "s2", None]]
    docs = [[*d[:4], len(d[1]) if d[1] is not None else None] for d in docs]
    # Columns with the names that stages use inside.
    df = spark.createDataFrame([tuple(d) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df.select("*", *(F.lit("x").alias(c) for c in ("score", "node", "band", "text_tag", "tag", "size", "h", "a", "b", "sketch", "words", "comp", "row"))).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages_and_run(spark, folder):
    import corpus_pipeline as P

    docs = table(spark, folder, "documents")
    kept = {}
    at = docs
    for name, stage in P.STAGES:
        before = at
        at = stage(spark, at, folder)
        if name != P.STAGES[-1][0]:
            assert at.columns == docs.columns
        kept[name] = {r.doc_id: r for r in at.collect()}
        at = spark.createDataFrame([tuple(r) for r in at.collect()], at.schema)
        assert before is not at
    clean = {i for i in range(400) if i % 5} | {900, 901, 950, None}
    assert set(kept["toxicity"]) == clean
    left = {i: r for i, r in kept["toxicity"].items() if i is not None}
    groups = plain_groups({i: r.text for i, r in left.items()})
    assert set(kept["simhash_dedup"]) == {i for i, c in groups.items() if i == c} | {None}
    assert {6, 7, 901} & set(kept["simhash_dedup"]) == set()
    assert set(kept["decontamination"]) == set(kept["simhash_dedup"]) - {1, 2}
    assert set(kept["secret_scan"]) == set(kept["decontamination"])
    assert "[REDACTED]" in kept["secret_scan"][8].text
    assert "0123456789abcdef" not in kept["secret_scan"][8].text
    assert kept["secret_scan"][8].n_chars == len(kept["secret_scan"][8].text)
    same = {i for i in kept["secret_scan"] if kept["secret_scan"][i] != kept["decontamination"][i]}
    assert same == {8}
    mixed = kept["source_mixing"]
    assert all(r.copies > 0 and r.taken == r.copies * len((r.text or "").split()) for r in mixed.values())
    assert 900 in mixed  # without words, of a source that is taken whole
    got = {r.doc_id: tuple(r) for r in P.run(spark, folder).collect()}
    assert got == {i: tuple(r) for i, r in mixed.items()}


def test_empty_tables(spark, folder, tmp_path):
    import corpus_pipeline as P

    for name in ("documents", "labels", "benchmark"):
        table(spark, folder, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
