"""The corpus pipeline, stage by stage, against plain Python on what each stage was given."""

from __future__ import annotations

import re
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from aprlens.llm.shared import kept, table

from .conftest import WORD, lowered

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Name, input and output rows of each stage."""
    docs, out = table(spark, SMALL, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        result = kept(stage(spark, docs, SMALL), "stage")
        out.append((name, docs, result))
        docs = result
    return out


def shingles(text):
    words = WORD.findall(lowered(text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))}


def test_columns_stay_until_the_last_stage(stages):
    assert [n for n, _, _ in stages] == ["quality rules", "near dedup", "personal data", "packing"]
    first = stages[0][1].schema
    assert all(out.schema == first for _, _, out in stages[:-1])


def test_quality_keeps_good_rows_and_drops_short_ones(spark, stages):
    _, docs, out = stages[0]
    left = {r["doc_id"] for r in out.select("doc_id").collect()}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SMALL, "labels").collect()}
    for r in docs.collect():
        words = WORD.findall(r["text"] or "")
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        assert not (failed and r["doc_id"] in left)
        if labels.get(r["doc_id"]) == 1 and not failed:
            assert r["doc_id"] in left
        if labels.get(r["doc_id"]) == 0:
            assert r["doc_id"] not in left


def test_one_document_of_each_group_stays(stages):
    _, docs, out = stages[1]
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = root(i), root(j)
                group[max(x, y)] = min(x, y)
    expected = {rows[i][0]: rows[i][1] for i in range(len(rows)) if root(i) == i}
    assert {r["doc_id"]: r["text"] for r in out.collect()} == expected


def test_personal_data_is_gone_and_the_rest_stays(stages):
    _, docs, out = stages[2]
    pattern = re.compile(
        r"[\w.]+@[\w.]+\w|(?<!\d)\d{16}(?!\d)|\+1 \(\d{3}\) \d{3}-\d{4}|AKIA\w{16}|(?<=password=)\w+"
        r'|(?<=token = ")\w+|(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}'
    )

    def luhn(m):
        return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(int(c) for c in reversed(m))) % 10 == 0

    def found(text):  # numbers that only look like a card are left alone
        return [m for m in pattern.findall(text) if not re.fullmatch(r"\d{16}", m) or luhn(m)]

    def masked(text):
        return pattern.sub(lambda m: "*" if found(m.group()) else m.group(), text)

    before, after = ({r["doc_id"]: r["text"] for r in df.collect()} for df in (docs, out))
    assert before.keys() == after.keys()
    old = {m for t in before.values() for m in found(t)}
    new = {m for t in after.values() for m in found(t)}
    assert old and not old & new and len(old) == len(new)
    for doc_id, text in before.items():
        assert masked(text) == masked(after[doc_id])


def test_every_token_is_packed(stages):
    _, docs, out = stages[3]
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    expected = {r["doc_id"]: len(whole.encode(r["text"], add_special_tokens=False).ids) + 1 for r in docs.collect()}
    found = Counter()
    for r in out.collect():
        found[r["doc_id"]] += r["n_tokens"]
    assert found == expected


def test_stages_stand_odd_rows(spark, odd_docs, no_docs, tmp_path):
    """Nulls, repeated rows, clashing names and empty tables, each stage on its own."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, odd_docs, str(tmp_path))
        n = result.count()
        if name != "packing":
            assert result.schema == odd_docs.schema and 0 < n <= odd_docs.count()
        assert stage(spark, no_docs, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
