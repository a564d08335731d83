import re
from collections import defaultdict

import numpy as np

from leafspark.llm import substring_dedup as S
from leafspark.llm.npbytes import text_buffer
from leafspark.llm.substring_dedup import drop_repeated_spans

A = "Alpha beta gamma delta one two. Epsilon zeta eta theta three four. Iota kappa lambda mu five six. Nu xi omicron pi seven eight. "
B = "Some other words that are here only once. And nothing of it comes back again. "


def run(spark, rows):
    return {r.doc_id: r for r in drop_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def word_hash(word):
    import pyarrow as pa

    return int(S.words(*text_buffer(pa.array([word])))["hash"][0])


def brute(rows, min_words):
    """The words of each text that stay, with plain lists and tuples of words; rows are (id, text) with ids in order."""
    cache, cut = {}, []
    for _, text in rows:
        found = [(m.group(), m.start()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        words = [w for w, _ in found]
        h = [cache.setdefault(w, word_hash(w)) for w in words]
        starts = {0} if words else set()
        for i, w in enumerate(words[:-1]):
            if re.search(r"[.!?]$|[.!?][\"')\]}]$", w) or "\n" in text[found[i][1] : found[i + 1][1]]:
                starts.add(i + 1)
        for i in range(len(words) - S.GAP + 1):
            starts |= {j + 1 for j in range(i, i + S.GAP) if h[j] == min(h[i : i + S.GAP])}
        starts = sorted(x for x in starts if x < len(words))
        cut.append((words, starts))
    spans, first = [], {}
    for d, (words, starts) in enumerate(cut):
        edges = [*starts, len(words)]
        own = set()
        for i in range(len(starts)):
            ends = [e for k, e in enumerate(edges) if k >= i + 2 and e - edges[i] >= min_words]
            own |= {(edges[i], min(ends))} if ends else set()
            fronts = [e for k, e in enumerate(edges[:-1]) if k <= i - 1 and edges[i + 1] - e >= min_words]
            own |= {(max(fronts), edges[i + 1])} if fronts else set()
        spans.append(sorted(own))
        for a, b in sorted(own):
            first.setdefault(tuple(words[a:b]), (d, a, b))
    out = []
    for d, (words, _) in enumerate(cut):
        gone = [False] * len(words)
        again = [(a, b) for a, b in spans[d] if first[tuple(words[a:b])][:2] != (d, a)]
        for a, b in again:
            gone[a:b] = [True] * (b - a)
        base = list(gone)
        for a, b in again:
            e, x, y = first[tuple(words[a:b])]
            other, low, high = cut[e][0], a, b
            limit = min(S.GROWTH, max(0, a - y)) if e == d else S.GROWTH  # a text's own first occurrence
            if a == 0 or not base[a - 1]:
                while low > 0 and x - (a - low) > 0 and a - low < S.GROWTH and words[low - 1] == other[x - (a - low) - 1]:
                    low -= 1
            if b == len(words) or not base[b]:
                while high < len(words) and y + high - b < len(other) and high - b < limit and words[high] == other[y + high - b]:
                    high += 1
            gone[low:high] = [True] * (high - low)
        out.append([w for w, g in zip(words, gone) if not g])
    return out


def test_matches_brute_force(spark, docs):
    rows = [(r.doc_id, r.text or "") for r in docs.orderBy("doc_id").collect()][:120]
    rng = np.random.default_rng(4)
    for i in range(12):
        source, host = rows[i * 5][1].split(), rows[i * 7 + 1][1].split()
        if len(source) > 60:
            at, to = int(rng.integers(0, len(source) - 55)), int(rng.integers(0, len(host) + 1))
            rows.append((50_000 + i, " ".join([*host[:to], *source[at : at + 55], *host[to:]])))
    got = run(spark, rows)
    want = brute(rows, S.MIN_WORDS)
    assert [got[i].text.split() for i, _ in rows] == [[w for x in words for w in x.split()] for words in want]
    assert sum(got[i].n_words_removed for i, _ in rows) > 1000
    for i, text in rows:
        kept, at = "", 0
        for r in got[i].removed:
            kept, at = kept + text[at : r.start], r.end
        assert kept + text[at:] == got[i].text


def test_first_occurrence_stays_and_later_ones_go(spark):
    out = run(spark, [(1, B + A), (2, A + "A tail that is new to all."), (3, "In front stands this. " + A), (4, B[:20])])
    assert out[1].text == B + A and out[1].n_removed == 0
    assert out[2].text == "A tail that is new to all." and out[2].removed[0].start == 0
    assert out[3].text.strip() == "In front stands this."
    assert out[4].text == B[:20]


def test_repeats_within_a_text(spark):
    out = run(spark, [(1, A + B + A)])
    assert out[1].text == A + B and [tuple(x) for x in out[1].removed] == [(len(A + B), len(A + B + A))]


def test_short_repeats_stay(spark):
    out = run(spark, [(1, "Yes. No. Maybe so."), (2, "Yes. No. Maybe so.")])
    assert out[2].text == "Yes. No. Maybe so."


def test_planted_passages_go_to_their_ends(spark):
    """51 words pasted anywhere, with or without punctuation: all of them go, and next to nothing else."""
    rng = np.random.default_rng(9)
    words = np.array([f"{a}{b}" for a in "bcdfghklmnprst" for b in ("an", "or", "it", "ul", "em", "ax", "ick", "oon")])
    rows, planted = [], {}
    for k in range(60):
        passage = [w + "." * (k % 2 and i % 11 == 5) for i, w in enumerate(rng.choice(words, 51))]
        for copy in range(3):
            host = [w + "." * (i % 9 == 3) for i, w in enumerate(rng.choice(words, 150))]
            at = int(rng.integers(0, 151))
            planted[len(rows)] = (copy, host)
            rows.append((len(rows), " ".join([*host[:at], *passage, *host[at:]])))
    out = run(spark, rows)
    stay = [len(out[i].text.split()) - 150 for i, (copy, _) in planted.items() if copy]
    assert np.mean(np.maximum(stay, 0)) < 1.5
    for i, (copy, host) in planted.items():
        assert out[i].n_words_removed == 0 if copy == 0 else 40 <= out[i].n_words_removed <= 53
        assert copy == 0 or abs(len(out[i].text.split()) - 150) <= 11


def test_scripts_without_spaces(spark):
    passage = "春眠不觉晓处处闻啼鸟。夜来风雨声花落知多少。床前明月光疑是地上霜。举头望明月低头思故乡。白日依山尽黄河入海流。"
    out = run(spark, [(1, "甲乙丙丁戊己庚辛壬癸" + passage + "完"), (2, "子丑寅卯辰巳午未申酉戌亥。" + passage + "一二三四五。"), (3, "子丑寅卯。")])
    left = out[2].text
    assert out[1].n_removed == 0 and out[3].n_removed == 0
    assert left.startswith("子丑寅卯辰巳午未申酉戌亥。") and left.endswith("一二三四五。") and len(left) <= 19 + 8 and "夜来风雨" not in left


def test_rows_that_share_or_lack_an_id(spark):
    """A document is an id and a text: the least keeps a passage, and no id gathers all rows that share or lack one."""
    rows = [(None, "Only here stands this first thing. " + A), (None, "And this is another text altogether. " + A), (5, B + A), (5, "Five is its number as well. " + A), (7, A), (7, A)]
    out = drop_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.text for r in out if r.doc_id == 7] == [A, A]
    assert sorted(r.text for r in out if r.doc_id is None) == ["And this is another text altogether. ", "Only here stands this first thing. "]
    assert sorted(r.text for r in out if r.doc_id == 5) == ["Five is its number as well. ", B]
    out = drop_repeated_spans(spark.createDataFrame(rows[:4], "doc_id long, text string")).collect()
    assert sum(A in r.text for r in out) == 1 and len(out) == 4


def test_odd_rows(spark, odd, empty):
    rows = drop_repeated_spans(odd).collect()
    assert len(rows) == odd.count()
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r.text)
    before = defaultdict(list)
    for r in odd.collect():
        before[r.doc_id].append(r.text)
    assert all(sorted(map(str, got[i])) == sorted(map(str, before[i])) for i in (1, 3, 4, 5, 7, 8, None))
    assert got[2][0] == got[2][1] and len(got[6][0].split()) < 60
    assert drop_repeated_spans(empty).count() == 0
