"""Sharding, mixing, quality rules and chat formatting."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafspark.llm import chat, mixing, sharding, weak_quality
from leafspark.llm.ordinals import with_ordinal

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_shards_are_contiguous_balanced_and_gapless(name, request):
    docs = request.getfixturevalue(name)
    rows = docs.select("doc_id", "text").collect()
    out = sharding.shard_documents(docs, 24, 8).collect()
    assert len(out) == len(rows)
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    order = sorted(out, key=lambda r: (r.shard, r.slot))
    assert [r.before for r in order] == sorted(r.before for r in order)
    slots = defaultdict(list)
    for r in order:
        slots[r.shard].append(r.slot)
    assert all(s == list(range(len(s))) for s in slots.values())
    total, largest = sum(r["size"] for r in out), max(r["size"] for r in out)
    for shard, _ in slots.items():
        assert abs(sum(r["size"] for r in out if r.shard == shard) - total / 24) <= largest + 1


def test_sharding_ties_and_empty(spark, empty):
    same = spark.createDataFrame([(1, "abc")] * 100, "doc_id long, text string")
    counts = Counter(r.shard for r in sharding.shard_documents(same, 4).collect())
    assert counts == {0: 25, 1: 25, 2: 25, 3: 25}
    assert sharding.shard_documents(empty).count() == 0


def test_written_shards(spark, odd, tmp_path):
    sharding.write_shards(odd, str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == odd.count() and set(back.columns) == {*odd.columns, "shard"}
    same = spark.createDataFrame([(1, "abc")] * 100 + [(None, "x")] * 20, "doc_id long, text string")
    sharding.write_shards(same, str(tmp_path / "t"), 4)
    want = Counter((r.doc_id, r.shard) for r in sharding.shard_documents(same, 4).collect())
    assert Counter((r.doc_id, r.shard) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == want


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        level = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if level[s] > most * sizes[s]]
        if not over:
            return {s: most * sizes[s] if s in capped else level[s] for s in names}
        capped |= set(over)


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_mixing_follows_water_filling(name, request):
    docs = request.getfixturevalue(name)
    rows = docs.select("source", "text").collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    want = brute_targets(sizes)
    plan = mixing.repetition_plan(docs).collect()
    assert len(plan) == len(rows)
    for r in plan:
        assert r.target == pytest.approx(want[r.row.source]) and r.source_size == sizes[r.row.source]
        rate = r.target / r.source_size if r.source_size else 0
        assert int(rate) <= r.copies <= int(rate) + (rate % 1 > 0) and r.copies <= 3
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in plan)


def test_equal_rows_are_drawn_each_on_its_own(spark):
    """A source whose rows have no id, or one row many times, still comes near its target; reruns agree."""
    rows = [(None, "a b c d e", "a")] * 400 + [(7, f"t{i} x", "b") for i in range(500)] + [(i, "w " * 20, "c") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    took = [Counter((r.row.doc_id, r.row.text, r.row.source, r.copies) for r in mixing.repetition_plan(d).collect()) for d in (docs, docs.repartition(7))]
    assert took[0] == took[1]
    plan = mixing.repetition_plan(docs)
    for r in plan.groupBy("row.source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect():
        assert r.taken == pytest.approx(r.target, rel=0.1)


def test_ordinals_of_a_hot_key(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(500)] + [(f"k{i % 40}", i) for i in range(60)], "k string, x int").repartition(9)
    got = with_ordinal(rows, ["k"]).collect()
    of = defaultdict(list)
    for r in got:
        of[r.k].append(r.nth)
    assert len(got) == 560 and all(sorted(v) == list(range(len(v))) for v in of.values()) and len(of["hot"]) == 500


def test_mixing_empty(empty):
    assert mixing.mix_sources(empty).count() == 0


def brute_quality(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[words[i], words[i + 1], words[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_quality_measures_match_brute_force(name, request):
    docs = request.getfixturevalue(name)
    got = weak_quality.score_quality(docs.select("doc_id", "text"), ["doc_id", "text"]).collect()
    assert len(got) == docs.count()
    for r in got:
        n, chars, symbols, dup, repeat = brute_quality(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat), r.doc_id
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert not (r.base_failed and r.kept)


def test_windows_that_share_a_hash_are_told_apart(spark, docs, monkeypatch):
    """With a hash of a few values, counts are still exact."""
    monkeypatch.setattr(weak_quality, "WINDOW_HASH", "cast(length(words[i]) % 3 as bigint)")
    rows = weak_quality.measures(docs.where("length(text) < 3000").select("doc_id", "text"), ["doc_id", "text"]).select("text", "n_repeat_words").collect()
    assert all(r.n_repeat_words == brute_quality(r.text)[4] for r in rows) and sum(r.n_repeat_words > 0 for r in rows) > 3


START = [[0.02] * 8] + [[0.9 if r == k else 0.2 for r in range(8)] for k in range(8)]


def plain_posterior(share, bad, votes):
    joint = [s * math.prod(p if v < 0 else 1 - p if v > 0 else 1 for p, v in zip(rates, votes)) for s, rates in zip(share, bad)]
    return [j / sum(joint) for j in joint]


def plain_em(votes, rounds=60):
    """EM row by row: no table of patterns."""
    share, bad = [0.8] + [0.025] * 8, START
    for _ in range(rounds):
        posts = [plain_posterior(share, bad, v) for v in votes]
        mass = [sum(p[c] for p in posts) for c in range(9)]
        new = []
        for c in range(9):
            new.append([])
            for r in range(8):
                down = sum(p[c] for p, v in zip(posts, votes) if v[r] < 0)
                up = sum(p[c] for p, v in zip(posts, votes) if v[r] > 0)
                expected = 0.01 if c == 0 else 0.9 if r == c - 1 else 0.2
                weight = (0.1 if c == 0 or r == c - 1 else 0.01) * mass[c] + 1
                new[c].append((down + weight * expected) / (down + up + weight))
        bad, share = new, [(m + 0.001 * len(votes)) / (len(votes) * 1.009) for m in mass]
    return share, bad


def test_em_equals_a_plain_version(spark, docs):
    voted = weak_quality.votes(weak_quality.measures(docs, ["doc_id"]))
    share, bad = plain_em([r.votes for r in voted.select("votes").collect()])
    model = weak_quality.estimate(voted)
    assert np.allclose(model["share"], share) and np.allclose(model["bad"], bad)


def test_the_posterior_is_not_all_must_pass(spark):
    """One bad vote of a rule that the others don't second is outvoted; the same text under two rules' bad votes goes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    clean = [r.text for r in docs.where("doc_id < 400").collect() if r.text and 200 < len(r.text.split()) < 400 and brute_quality(r.text)[2] == 0 and brute_quality(r.text)[4] == 0][:2]
    excited = " ".join(w + "!" if i % 5 < 2 else w for i, w in enumerate(clean[0].split()))
    junk = " ".join(w + "#$%" if i % 5 < 2 else w for i, w in enumerate(clean[1].split()))
    more = spark.createDataFrame([(-1, clean[0]), (-2, excited), (-3, junk)], "doc_id long, text string")
    got = {r.doc_id: r for r in weak_quality.score_quality(docs.unionByName(more), ["doc_id"]).where("doc_id < 0").collect()}
    assert min(got[-1].votes) == 1 and got[-1].kept
    assert got[-2].votes.count(-1) == 1 and got[-2].kept, "all-must-pass would reject it"
    assert got[-3].votes[2] == -1 and not got[-3].kept


def test_em_tells_good_from_bad(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    got = weak_quality.score_quality(docs, ["doc_id"]).join(labels, "doc_id").where("not base_failed")
    rows = got.select("kept", labels.quality.alias("good")).collect()
    good, bad = [r.kept for r in rows if r.good == 1], [r.kept for r in rows if r.good == 0]
    assert sum(good) / len(good) > 0.98
    assert not bad or sum(bad) / len(bad) < 0.2


def test_quality_filter_keeps_columns(odd, empty):
    assert weak_quality.filter_quality(odd).columns == odd.columns
    assert weak_quality.filter_quality(empty).count() == 0


def test_chat_round_trip(spark):
    rows = [
        (1, 1, "user", "a<b"),
        (1, 0, "system", None),
        (1, 2, "assistant", "x\\s </turn> \\l > ok"),
        (1, 2, "assistant", "second of equal turn"),
        (1, 3, "user", "tail"),
        (2, 0, "user", "only a user"),
        (None, 0, "assistant", "no id"),
        (None, None, None, None),
        (-7, 0, "user", r"\### Assistant: </turn> ok"),
        (-7, 1, "assistant", r"\### Assistant: </turn> ok"),
        (3, 0, "assistant", ""),
        (4, 0, "we<ird> \\role", "日本 \U0001f600" * 3000),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    examples = chat.format_examples(frame)
    got = {r.conv_id: r for r in chat.digests(examples).collect()}
    said = defaultdict(list)
    for c, t, role, text in rows:
        said[c].append(((t is not None, t or 0), role or "", text or ""))
    assert set(got) == set(said)
    for c, turns in said.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert examples.where("conv_id = 1").count() == 3
    assert examples.where("loss_end > loss_start").count() == 4
    assert chat.format_examples(frame.where(F.lit(False))).count() == 0


def test_votes_do_not_depend_on_length(spark):
    """A clean text of 300,000 words votes as its beginning does, save for its length, and one of repeats stays bad."""
    rng = np.random.default_rng(2)
    words = [f"w{x}." if x % 20 == 0 else f"word{x}" for x in rng.integers(0, 20_000, 300_000)]
    again = rng.choice(words[:200], 60_000).tolist()
    rows = [(1, " ".join(words[:20_000])), (2, " ".join(words)), (3, " ".join(again)), (4, " ".join(words[:15_000] * 2))]
    measured = weak_quality.measures(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"])
    out = {r.doc_id: r for r in weak_quality.votes(measured).collect()}
    assert out[2].votes[1:] == out[1].votes[1:] and out[2].votes[5] == 1
    assert out[3].votes[5] == -1
    inside = sum(brute_quality(" ".join(part))[4] for part in (rows[3][1].split()[:20_000], rows[3][1].split()[20_000:]))
    assert out[4].repeat_share == inside / 30_000 and out[4].n_repeat_words == 30_000
