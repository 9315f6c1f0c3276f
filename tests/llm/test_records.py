"""Conversation repair, Merkle manifest and toxicity."""

from __future__ import annotations

import hashlib
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aprlens.llm import conversations, merkle, toxicity
from aprlens.llm.shared import table

SF = "/root/testdata/sf0.01"
BLANKS = " \t\n\x0b\x0c\r"
TURNS = "conv_id long, turn long, role string, text string"


# --- conversations -------------------------------------------------------------------------------------------


def digest_order(row):
    turn, role, text = row
    return turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def repaired(rows):
    """Counts, cost, audit and repaired rows: all cheapest prefixes by state, as strings."""
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(BLANKS)
        faults.append("b" if not bare else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t")
        seen.add((role, text))
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def lowest(found, state, entry):
        if state not in found or entry < found[state]:
            found[state] = entry

    def with_inserts(found):
        for _ in range(3):
            for state, (cost, audit, out) in list(found.items()):
                for to in follow[state].replace("s", ""):
                    lowest(found, to, (cost + 2, audit + "I", out + (name[to] + ":",)))
        return found

    best = {"": (0, "", ())}
    for (_, role, text), fault in zip(rows, faults, strict=True):
        step = {}
        for state, (cost, audit, out) in with_inserts(best).items():
            lowest(step, state, (cost + 3, audit + "D", out))
            if fault not in ("b", "d"):
                more = cost + (fault == "t")
                if role[:1] and role[0] in follow[state]:
                    lowest(step, role[0], (more, audit + "K", out + (f"{role}:{text}",)))
                for to in follow[state].replace("s", ""):
                    lowest(step, to, (more + 2, audit + "R", out + (f"{name[to]}:{text}",)))
        best = step
    best = with_inserts(best)
    cost, audit, out = min(best[s] for s in ("", "a") if s in best)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [p[1][:1] + q[1][:1] for p, q in zip(rows, rows[1:], strict=False)]
    illegal = sum(p not in ("su", "ua", "au") for p in pairs)
    return (gaps, *map(faults.count, "bdt"), illegal, cost, audit), out


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(5)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "User"]
    texts = ["Hi.", "No end", "Yes!", "", "  \n", "a?\t", None, "Well. \u0085", "long " * 5_000]
    rows = []
    for conv in range(150):
        for turn in range(rng.randint(1, 12)):
            at = rng.choice([turn, turn, turn + 3, None])
            rows.append((conv or None, at, rng.choice([*roles, None]), rng.choice(texts)))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


@pytest.mark.parametrize("spill_rows", [conversations.SPILL_ROWS, 2])
def test_repairs_equal_brute_force(spark, turns, spill_rows):
    by = {}
    for conv, turn, role, text in turns:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    df = spark.createDataFrame([(*r, "x", 1) for r in turns], TURNS + ", audit string, cost int").repartition(4)
    found = {r[0]: tuple(r)[1:] for r in conversations.repair_digests(df, spill_rows).collect()}
    rows = {}
    for r in conversations.repaired_turns(df, spill_rows).collect():
        rows.setdefault(r["conv_id"], {})[r["position"]] = f"{r['role']}:{r['text']}"
    for conv, own in by.items():
        counts, out = repaired(sorted(own, key=digest_order))
        assert found[conv] == (*counts, hashlib.sha256("\n".join(out).encode()).hexdigest())
        assert tuple(v for _, v in sorted(rows.get(conv, {}).items())) == out
    assert found.keys() == by.keys()


def test_a_giant_conversation_of_repeats(spark):
    n = 40_000
    df = spark.range(n).select(F.lit(1).alias("conv_id"), F.lit(7).alias("turn"), F.lit("user").alias("role"), F.lit("Hi.").alias("text"))
    (row,) = conversations.repair_digests(df, 1_000).collect()
    assert (row["duplicate"], row["illegal"], row["gaps"], row["cost"]) == (n - 1, n - 1, 0, 3 * (n - 1) + 2)
    assert row["audit"] == "K" + "D" * (n - 1) + "I"
    assert row["repaired_sha256"] == hashlib.sha256(b"user:Hi.\nassistant:").hexdigest()


def test_damage_and_conversations_without_rows(spark):
    rows = [(c, t, "user", "A. b!") for c in range(300) for t in (0,)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, TURNS)
    fault = {c: zlib.crc32(f"{c}:0".encode()) % 20 for c in range(300)}
    damaged = {}
    for r in conversations.damaged(df).collect():
        damaged.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    for c, kind in fault.items():
        text = "" if kind == 1 else "A b" if kind == 2 else "A. b!"
        assert damaged.get(c, []) == ([] if kind == 0 else [("user", text)] * (2 if kind == 3 else 1))
    found = {r["conv_id"]: r for r in conversations.damage_repaired(df).collect()}
    assert found.keys() == {None, *range(300)}
    empty = found[next(c for c, kind in fault.items() if kind == 0)]
    assert (empty["cost"], empty["audit"], empty["repaired_sha256"]) == (0, "", hashlib.sha256().hexdigest())
    assert conversations.damage_repaired(df.limit(0)).count() == 0


# --- Merkle --------------------------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in merkle.LEAF_FIELDS))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def sides(tree, i):
    for level in tree[:-1]:
        run = level[i // 3 * 3 : i // 3 * 3 + 3]
        yield run[: i % 3], run[i % 3 + 1 :]
        i //= 3


def in_order(rows):
    return sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))


def some_docs(n, sources, seed=1):
    rng = random.Random(seed)
    texts, names = [None, "", "a\nb", "é\n", "x" * 100_000], [None, *[f"src{k}" for k in range(sources)], *["a"] * sources]
    rows = [
        {
            "doc_id": rng.choice([i, i, i, None]), "text": rng.choice(texts), "lang": rng.choice(["en", None]),
            "source": rng.choice(names), "n_chars": rng.choice([3, None]),
        }
        for i in range(n)
    ]
    return rows + rows[:3]


DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf int, tree string"


@pytest.mark.parametrize(("n", "sources", "height"), [(150, 3, 1), (200, 30, 2), (1, 1, 1), (90, 2, 7)])
def test_manifest_equals_brute_force(spark, n, sources, height):
    rows = some_docs(n, sources)
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([leaf(r) for r in in_order(by[s])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    expected = []
    for k, s in enumerate(names):
        for i, r in enumerate(in_order(by[s])):
            steps = [*sides(trees[s], i), *sides(top, k)]
            hit = r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            fold = leaf({**r, "text": r["text"].replace("\n", "")} if hit else r)
            for before, after in steps:
                fold = h(*before, fold, *after)
            proof = h(*(d for before, after in steps for d in before + after))
            expected.append((r["doc_id"], leaf(r), trees[s][-1][0], top[-1][0], proof, fold, fold == top[-1][0]))
    df = spark.createDataFrame([(*r.values(), 1, "x") for r in rows], DOCS).repartition(3)
    assert sorted(map(tuple, merkle.verified(df, height).collect()), key=str) == sorted(expected, key=str)
    log = {}
    for r in merkle.postorder_log(merkle.manifest(df, height=height).forest).collect():
        log.setdefault(r["tree"], {})[r["position"]] = r["digest"]

    def finished(tree, level, j):
        below = range(3 * j, min(3 * j + 3, len(tree[level - 1]))) if level else ()
        return [*(d for c in below for d in finished(tree, level - 1, c)), tree[level][j]]

    for s in names:
        assert [log[s][p] for p in range(len(log[s]))] == finished(trees[s], len(trees[s]) - 1, 0)


def test_manifest_of_nothing(spark):
    assert merkle.verified(spark.createDataFrame([], DOCS)).count() == 0


# --- toxicity ------------------------------------------------------------------------------------------------


def test_ngrams_are_those_of_each_word():
    words = ["a", "ab", "idiot", "日本語", "x" * 50]
    holder, bucket = toxicity.word_ngrams(words)
    for k, word in enumerate(words):
        whole = f"\n{word}\n"
        expected = sum(max(len(whole) - n + 1, 0) for n in toxicity.ORDERS)
        alone = toxicity.word_ngrams([word])[1]
        assert (holder == k).sum() == expected == len(alone) and sorted(bucket[holder == k]) == sorted(alone)
    assert [len(x) for x in toxicity.word_ngrams([])] == [0, 0]


def test_logistic_step_reaches_the_optimum():
    """The gradient of the penalised loss, taken numerically over the words of a small fit, is near zero."""
    import numpy as np

    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(60, 4)), rng.random(60) < 0.4
    weight = np.full(60, 1 / 60)
    v, bias = toxicity._logistic(lambda u: x @ u, lambda u: x.T @ u, 4, y.astype(float), weight, 0.05, 50)
    p = 1 / (1 + np.exp(-(x @ v + bias)))
    assert abs(x.T @ (weight * (p - y)) + 0.05 * v).max() < 1e-3 and abs(weight @ (p - y)) < 1e-3


def test_held_out_rows_are_told_apart(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    found = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(found) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in found.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found.values())
    marked = [(found[r["doc_id"]], r["toxic"]) for r in labels.collect()]
    held = [(r["predicted"], toxic) for r, toxic in marked if r["held_out"]]
    assert sum(p == t for p, t in held) / len(held) > 0.95
    high = sorted(r["score"] for r, toxic in marked if r["held_out"] and toxic)
    low = sorted(r["score"] for r, toxic in marked if r["held_out"] and not toxic)
    better = sum(h > x for h in high for x in low)
    assert better / (len(high) * len(low)) > 0.95


def test_held_out_labels_change_nothing(spark):
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    out = toxicity.held_out(F.col("doc_id"))
    turned = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [{r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, given).collect()} for given in (labels, turned)]
    assert scores[0] == scores[1]


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 1), (5, 0), (10, 0), (12, None), (None, 1), (8, 7)], "doc_id long, toxic int")
    found = toxicity.toxicity(odd_docs, labels).collect()
    assert len(found) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in found)
    bare = {r["score"] for r in found if r["doc_id"] in (0, 1, 2)}
    assert len(bare) == 1
    assert toxicity.toxicity(no_docs, labels).count() == 0
    alone = toxicity.toxicity(odd_docs, labels.limit(0)).collect()
    assert {r["predicted"] for r in alone} == {0}


def test_fit_does_not_depend_on_batches():
    words = [["idiot", "the"], ["the", "of"], ["idiots", "of"], ["and", "of"]] * 5
    toxic = pa.array([1, 0, 1, 0] * 5).to_numpy() == 1
    fitted = toxicity.Classifier.fit(pa.array(words), toxic, 0.5)
    texts = ["an idiot", "of the", None, "idiotic " * 9]
    together = toxicity._Scorer(fitted).scores(texts)
    assert together == [toxicity._Scorer(fitted, most=1).scores([t])[0] for t in texts]
    assert together[0] > 0.5 > together[1]
