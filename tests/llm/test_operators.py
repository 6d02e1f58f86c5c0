"""The corpus operators against brute force, and their corner cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from harness import compare
from pyspark.sql import functions as F

from folioframe.llm import bitsliced, decision_list, graph, language_id, line_dedup, minhash, mixing, packing, queries, rule_ensemble, runtime, sharding, substrings, textstats
from folioframe.llm.graph import components
from folioframe.llm.words import WordHashes, lower_words, shingle_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} other{i % 331}" for i in range(15_000))
ODD = [
    (1, None, None, None, None), (2, "", "en", "s0", 0), (3, " \t\n ", "en", "s0", 4), (4, "one", "en", "s0", 3), (5, "one", "en", None, 3),
    (6, LONG, "en", "s1", len(LONG)), (7, LONG, "en", "s1", len(LONG)), (None, "text without an id", "fr", "s2", 18), (9, "çà et là été\nçà et là été", "fr", "s2", 20),
    (10, "same same same same", "en", "s0", 19), (10, "same same same same", "en", "s0", 19), (12, "🙂 emoji <|endoftext|> end", "en", "s3", 10),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def odd_clashing(odd):
    return odd.withColumns({"row": F.lit(1), "key": F.lit("k"), "size": F.lit("x"), "kept": F.lit(None).cast("string"), "shard": F.lit(3), "rank": F.lit(0), "mix_size": F.lit(9), "mix_row": F.lit(1), "_gone": F.lit(1), "_id": F.lit(2), "doc": F.lit(3), "print": F.lit("p"), "mix_source": F.lit(1), "mix_rate": F.lit(1), "mix_source_size": F.lit(1), "mix_target": F.lit(1), "rate": F.lit(7), "target": F.lit(1), "copies": F.lit(0), "rate_source": F.lit("r"), "draw": F.lit(0), "a.b": F.lit("dot"), "batch": F.lit(1), "part": F.lit(1), "cluster": F.lit(1), "first": F.lit(1), "n_words": F.lit(3)})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, name):
    assert compare(spark, sf_dir, queries.queries()[name], queries.oracle_sql()[name]) is None


# --- near duplicates ------------------------------------------------------------------------------------


def shingles(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute_components(docs, k, per_cent):
    sets = {i: shingles(t, k) for i, t in docs}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            u = len(sets[a] | sets[b])
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= per_cent * u:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_are_those_of_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf_dir).select("doc_id", "text").collect()]
    want = brute_components(rows, 3, 85)
    for r in queries.op1_minhash_dedup(spark, sf_dir).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], r.doc_id == want[r.doc_id][1])


def test_near_duplicates_in_a_large_chain(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows, text = [], list(base)
    for i in range(300):  # every copy changes a word of the one before or of the first
        if i % 3 == 0:
            text = list(base)
        text[rng.randrange(len(text))] = f"x{i}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, rows[0][1]) for i in range(200)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, block=64).collect()
    want = brute_components(rows, 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_near_duplicates_corner_cases(odd_clashing, none):
    got = minhash.near_duplicates(odd_clashing, 3, 85).collect()
    assert len(got) == len(ODD)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert [(r.n_shingles, r.component_id, r.kept) for r in by[1] + by[2] + by[3]] == [(0, 1, True), (0, 2, True), (0, 3, True)]
    assert (by[5][0].component_id, by[5][0].kept) == (4, False)
    assert by[7][0].component_id == 6
    assert (by[None][0].component_id, by[None][0].kept) == (None, True)
    assert len(by[10]) == 2
    assert minhash.near_duplicates(none).collect() == []
    assert sorted(r.doc_id for r in minhash.drop_near_duplicates(odd_clashing).collect() if r.doc_id) == [1, 2, 3, 4, 6, 9, 10, 10, 12]


def plain_signature(shingles, slots):
    """SuperMinHash of one set, element by element."""
    sig = [(slots, 0)] * slots
    for x in shingles.tolist():
        perm = list(range(slots))
        for level in range(slots):
            with np.errstate(over="ignore"):
                r = int(minhash.mix(np.array([x], np.uint64) + minhash.GOLD * np.uint64(level + 1))[0])
            k = level + ((r & 0xFFFFFFFF) * (slots - level) >> 32)
            perm[level], perm[k] = perm[k], perm[level]
            sig[perm[level]] = min(sig[perm[level]], (level, r >> 32))
    return [rank << 32 | fraction for rank, fraction in sig]


def test_signatures_are_those_of_the_plain_method():
    memo, rng = WordHashes(), random.Random(7)
    sets = [shingle_hashes([f"w{rng.randrange(900)}".encode() for _ in range(n)], 1, memo) for n in (1, 2, 3, 9, 40, 200, 700)]
    got = minhash.super_minhash(np.concatenate(sets), np.array([len(s) for s in sets]), 96)
    assert got.tolist() == [plain_signature(s, 96) for s in sets]
    together = minhash.band_keys([*sets, sets[0][:0]], 12)
    assert all((minhash.band_keys([s], 12)[0] == together[k]).all() for k, s in enumerate(sets))
    assert len(set((got[0] >> np.uint64(32)).tolist())) == 96  # one element deals every rank once


def test_signature_estimates_similarity():
    memo = WordHashes()
    words = [f"w{i}".encode() for i in range(400)]
    a, b = shingle_hashes(words[:300], 1, memo), shingle_hashes(words[100:], 1, memo)
    x, y = minhash.super_minhash(np.concatenate((a, b)), np.array([300, 300]), 256)
    assert abs((x == y).mean() - 0.5) < 0.1


def test_word_hashes_outgrow_their_table():
    memo, words = WordHashes(), [b"%d" % k for k in range(200_000)]
    want = [int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in words[::997]]
    assert memo.of(words)[::997].tolist() == want and memo.of(words[::997]).tolist() == want


def test_words_are_split_at_six_characters():
    text = "A\x0bb\x0cC\rd e f\x1cg\x85h É"
    assert [w.decode() for w in lower_words(text)] == [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]


def test_components_over_many_tasks(spark, monkeypatch):
    """A hub, a path and a comb; with few links held at a time most of them meet in the star rounds only."""
    monkeypatch.setattr(runtime, "HEAVY", 8)
    edges = [(5, k) for k in range(100, 400)] + [(k, k + 1) for k in range(500, 560)] + [(399, 500)] + [(k, k + 1000) for k in range(500, 560)]
    random.Random(0).shuffle(edges)
    rounds = []
    monkeypatch.setattr(graph, "_stars", lambda *a, f=graph._stars: rounds.append(1) or f(*a))
    for batch in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        monkeypatch.setattr(graph, "HELD", 500_000 if batch == "10000" else 3)
        got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()}
        assert set(got.values()) == {5} and len(got) == 422
    assert rounds


def test_components_plans_stay_small(spark, monkeypatch):
    """The driver keeps every plan and task: no plan of a round reads the links dozens of times, and few links need no round."""
    edges = [(k, k + 1) for k in range(60)] + [(k, k + 100) for k in range(60)]
    scans, labels = [], []

    def save(df, label, *by):
        scans.append(df._jdf.queryExecution().analyzed().collectLeaves().size())
        labels.append(label)
        return runtime.save(df, label, *by)

    monkeypatch.setattr(graph, "save", save)
    for held, stars in ((500_000, False), (3, True)):
        monkeypatch.setattr(graph, "HELD", held)
        scans.clear(), labels.clear()
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()}
        assert set(got.values()) == {0} and len(got) == 120 + 1
        assert max(scans) <= 8 and ("stars" in labels) == stars


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- sharding -------------------------------------------------------------------------------------------


def test_sharding(spark, sf_dir):
    rows = {r.doc_id: r.text for r in documents(spark, sf_dir).collect()}
    got = queries.op2_sharding(spark, sf_dir).collect()
    total, places = Counter(), defaultdict(list)
    for r in got:
        raw = (rows[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        total[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert len(got) == len(rows) and set(total) == set(range(8))
    assert max(total.values()) - min(total.values()) < 0.02 * max(total.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_slot_map_versions(spark, tmp_path):
    load = {s: (s * 37) % 101 + 1 for s in range(64)}
    first = sharding.SlotMap.first(4, 64)
    second = first.rebalanced(load)
    third = second.rebalanced(load, 5)
    moved = [s for s in range(64) if third.shard_of[s] != second.shard_of[s]]
    assert {third.shard_of[s] for s in moved} == {4} and third.version == 3
    for m in (first, second, third):
        m.store(spark, str(tmp_path / "maps"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "maps"), 2) == second


def test_shard_map_lives_on(spark, tmp_path):
    path = str(tmp_path / "map")
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 37).cast("int")).alias("text"))
    run = lambda d, n: {r.doc_id: (r.shard, r.virtual_slot, r.map_version) for r in sharding.shard(d, n, 256, path).collect()}
    one = run(docs, 8)
    assert run(docs, 8) == one and sharding.SlotMap.versions(spark, path) == [1, 2]  # nothing to move, no new version
    more = run(docs.unionByName(docs.filter("doc_id % 11 = 0").select(F.col("doc_id") + 10_000, "text").toDF("doc_id", "text")), 8)
    a, b = (sharding.SlotMap.load(spark, path, v) for v in (2, 3))
    moved = {s for s in range(256) if a.shard_of[s] != b.shard_of[s]}
    assert 0 < len(moved) < 60 and {one[i][1] for i in one if one[i][0] != more[i][0]} <= moved
    grown = run(docs, 9)
    assert sharding.SlotMap.versions(spark, path) == [1, 2, 3, 4]
    assert {grown[i][0] for i in grown if grown[i][0] != more[i][0]} == {8}  # rows move into the new shard alone
    assert {v for _, _, v in grown.values()} == {4}


def test_swaps_are_searched_in_full():
    rng = random.Random(2)
    load = {s: rng.randrange(1, 10**6) for s in range(4096)}
    got = sharding.SlotMap.first(8).rebalanced(load)
    total = Counter()
    for s, k in enumerate(got.shard_of):
        total[k] += load[s]
    assert max(total.values()) - min(total.values()) < 20


def test_sharding_corner_cases(odd_clashing, none):
    got = sharding.shard(odd_clashing, 3).collect()
    assert len(got) == len(ODD) and [r.size for r in got if r.doc_id == 1] == [1]
    assert all(sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got))) for k in range(3))
    assert sharding.shard(none, 3).collect() == []


# --- quality --------------------------------------------------------------------------------------------


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines, dup = text.split("\n"), 0
    for n, line in enumerate(lines):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:n]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def test_counts(spark, sf_dir):
    texts = {r.doc_id: r.text for r in documents(spark, sf_dir).collect()}
    for r in queries.op4_quality_rules(spark, sf_dir).collect():
        want = brute_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed and r.rule is None)
    for text in [x[1] for x in ODD] + ["a b c a b c", "a a a a", "x\nx\n\n\nx", "a|b <c>"]:
        assert textstats.count_text(text)[:5] == brute_counts(text)


def test_decision_list_finds_planted_rules(spark):
    rng = np.random.default_rng(5)
    names = list(textstats.features())
    x = rng.random((3000, len(names)))
    y = 1 - ((x[:, 2] > 0.7) | ((x[:, 4] > 0.5) & (x[:, 5] <= 0.3))).astype(int)
    rules = decision_list.learn(x, y, names)
    bad = np.zeros(len(x), bool)
    for rule in rules.rules:
        bad |= decision_list._holds(x, names, rule)
    assert (bad == (y == 0)).mean() > 0.98
    assert decision_list.learn(x, np.ones(3000, int), names).rules == []
    assert decision_list.learn(x[:0], y[:0], names).rules == []


def test_quality_on_labelled_rows(spark):
    big = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    got = queries.op3_quality_classifier(spark, big).collect()
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert len(got) == 1000 and sum(a == b for a, b in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    kept = [(r.kept, labels[r.doc_id]) for r in queries.op4_quality_rules(spark, big).collect() if r.doc_id in labels and not r.base_failed]
    assert sum(a == bool(b) for a, b in kept) / len(kept) > 0.95


def test_rule_ensemble_learns_and_is_sparse():
    rng = np.random.default_rng(2)
    names = list(textstats.features())
    x = rng.random((2000, len(names)))
    y = ((x[:, 1] > 0.4) & (x[:, 3] <= 0.8)).astype(int)
    model = rule_ensemble.fit(x, y, names)
    odds = np.full(len(x), model.bias)
    for rule, w in model.rules:
        odds += w * decision_list._holds(x, names, rule)
    assert ((odds > 0) == (y == 1)).mean() > 0.97 and 0 < len(model.rules) < 200
    assert rule_ensemble.fit(x[:0], y[:0], names).rules == []


def test_quality_corner_cases(spark, odd_clashing, none):
    labels = spark.createDataFrame([(4, 1, 0), (9, 0, 0), (10, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    empty = labels.limit(0)
    for lab in (labels, empty):
        assert decision_list.judge(odd_clashing, lab).count() == len(ODD)
        assert rule_ensemble.score(odd_clashing, rule_ensemble.train(odd_clashing, lab)).filter("score between 0 and 1").count() == len(ODD)
    assert decision_list.judge(none, labels).collect() == []
    kept = decision_list.keep_good(odd_clashing, empty)
    assert kept.columns == odd_clashing.columns and [r["a.b"] for r in kept.collect()] == ["dot"] * kept.count()
    tripled = odd_clashing.unionByName(odd_clashing).unionByName(odd_clashing)
    assert len(textstats.labelled_sample(tripled, labels, None, 2)[1]) == 2


def test_quality_verdicts_are_those_of_brute_force(spark):
    """The learned models applied once more in plain Python, over counts made with patterns."""
    big = "/root/testdata/sf0.01"
    docs, labels = documents(spark, big), spark.read.parquet(f"{big}/labels.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}

    def stats(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        n_words, chars, symbols, dup, repeat = brute_counts(t)
        upper, lower, digits = (len(re.findall(f"[{x}]", t)) for x in ("A-Z", "a-z", "0-9"))
        lines, over = t.count("\n") + 1, lambda a, b: a / max(b, 1)
        return {
            "words": n_words, "mean_word": over(chars, n_words), "symbol_share": over(symbols, n_words), "dup_line_share": over(dup, lines), "repeat_share": over(repeat, n_words),
            "distinct_share": over(len(set(words)), n_words), "top_word_share": over(max(Counter(words).values(), default=0), n_words), "upper_share": over(upper, upper + lower),
            "digit_share": over(digits, chars), "stop_share": over(len(re.findall("[.,]", t)), n_words), "mark_share": over(len(re.findall("[!?]", t)), n_words),
            "words_per_line": over(n_words, lines), "letter_share": over(upper + lower, chars),
        }

    value = {i: stats(t) for i, t in texts.items()}
    holds = lambda v, rule: all(v[n] <= x if op == "<=" else v[n] > x for n, op, x in rule)
    quality = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and r.doc_id in value}
    names = list(textstats.features())
    known = sorted(quality)
    x, y = np.array([[value[i][n] for n in names] for i in known], float), np.array([quality[i] for i in known])
    list_ = decision_list.learn(x, y, names)
    assert list_.rules
    for r in queries.op4_quality_rules(spark, big).collect():
        first = next((n for n, rule in enumerate(list_.rules) if holds(value[r.doc_id], rule)), None)
        assert r.rule == first and r.kept == (first is None and not r.base_failed)
    taught = [k for k, i in enumerate(known) if zlib.crc32(str(i).encode()) % 5]
    model = rule_ensemble.fit(x[taught], y[taught], names)
    for r in queries.op3_quality_classifier(spark, big).collect():
        odds = model.bias + sum(w for rule, w in model.rules if holds(value[r.doc_id], rule))
        assert abs(r.score - 1 / (1 + np.exp(-odds))) < 1e-9 and r.predicted == int(r.score >= 0.3)


# --- line dedup -----------------------------------------------------------------------------------------


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_line_runs_compact(spark):
    store, rng, n, last = line_dedup.LineRuns(spark), random.Random(6), Counter(), {}
    for b in range(11):  # 11 batches: runs on the levels 0, 1 and 3
        rows = {(bytes([rng.randrange(60)]) * 16, 1000 - 10 * b - rng.randrange(10)) for _ in range(40)}
        for key, doc in rows:
            n[key] += 1
            last[key] = max(last.get(key, 0), doc)
        store.add(spark.createDataFrame(sorted(rows), "key binary, doc_id long"))
    assert [x is not None for x in store.levels] == [True, True, False, True]
    with runtime.settings(spark, runtime.SORTED):
        for df in (store.merged(*store.runs[:2]), store.unseen(store.runs[0].select("key"))):
            plan = plan_of(df)
            assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    got = {bytes(r.key): (r.n_docs, r.last_doc) for r in store.frequent(5).collect()}
    assert got == {k: (n[k], last[k]) for k in n if n[k] >= 5}
    store.clear()
    assert store.frequent().collect() == []


@pytest.mark.parametrize("batches", [1, 2, 9])
def test_repeated_lines_do_not_depend_on_the_batches(spark, sf_dir, batches):
    docs = documents(spark, sf_dir)
    at = defaultdict(set)
    for r in docs.collect():
        for key in {line_dedup.line_key(x) for x in (r.text or "").split("\n")} - {None}:
            at[key].add(r.doc_id)
    want = sorted((i, k) for k, ids in at.items() if len(ids) >= 5 for i in ids if i != max(ids))
    got = line_dedup.repeated_lines(docs.unionByName(docs.limit(50)), batches=batches).collect()
    assert sorted((r.doc_id, bytes(r.key)) for r in got) == want


def test_line_dedup_incremental(spark):
    long_line = "this line is certainly longer than forty characters, is it not"
    store = line_dedup.LineRuns(spark)
    a = spark.createDataFrame([(1, f"{long_line}\nshort"), (2, "short")], "doc_id long, text string")
    b = spark.createDataFrame([(3, f"new\n {long_line.upper()} \nshort")], "doc_id long, text string")
    assert sorted(r.text for r in line_dedup.admit(a, store).collect()) == ["short", f"{long_line}\nshort"]
    assert [r.text for r in line_dedup.admit(b, store).collect()] == ["new\nshort"]


def test_line_dedup_corner_cases(spark, odd_clashing, none):
    x = "a line that is repeated in many documents of this small table"
    rows = [(i, f"{x}\nown {i}", "en", "s", 1) for i in range(6)] + [(None, x, "en", "s", 1), (5, x, "en", "s", 1)]
    got = line_dedup.dedupe_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.text for r in got if r.doc_id is not None and r.doc_id < 5) == [f"own {i}" for i in range(5)]
    assert {r.text for r in got if r.doc_id in (None, 5)} == {x, f"{x}\nown 5"}
    out = line_dedup.dedupe_lines(odd_clashing)
    assert out.columns == odd_clashing.columns and out.count() == len(ODD)
    assert line_dedup.dedupe_lines(none).collect() == []
    for some in (none, odd_clashing.withColumn("doc_id", F.lit(None).cast("long"))):
        assert line_dedup.repeated_lines(some, batches=3).collect() == []


# --- repeated substrings --------------------------------------------------------------------------------


def brute_cut(docs):
    seen, out = set(), {}
    for i, t in sorted(docs):
        raw, marks = (t or "").encode(), []
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                marks.append((s, s + 100))
            seen.add(raw[s : s + 100])
        kept, spans = substrings.cut(raw, marks)
        out[i] = (i, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_substrings_are_those_of_brute_force(spark, sf_dir):
    want = brute_cut([(r.doc_id, r.text) for r in documents(spark, sf_dir).collect()])
    assert {r.doc_id: tuple(r) for r in queries.op6_suffix_dedup(spark, sf_dir).collect()} == want


def test_substrings_corner_cases(spark, odd, none):
    passage = "".join(random.Random(4).choice("abcdefgh ") for _ in range(260))
    rows = [(1, "a" * 500), (2, "xy" * 200), (3, None), (4, ""), (5, "xy" * 200), (6, "b" * 99), (7, "q" + "a" * 130 + "w"), (8, f"é{passage}ü"), (9, f"{passage[:150]}--{passage[50:]}"), (20, passage[10:112])]
    got = {r.doc_id: tuple(r) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_cut(rows)
    twice = substrings.remove_repeats(odd.unionByName(odd.filter("doc_id = 6"))).collect()
    assert len({tuple(r) for r in twice if r.doc_id == 6}) == 1  # identical rows are one document
    assert [r.n_removed == r.n_bytes for r in twice if r.doc_id == 7] == [True]
    assert [r.n_removed for r in twice if r.doc_id is None] == [0]
    assert substrings.remove_repeats(none).collect() == []


@pytest.mark.parametrize("setting", ["plain", "short runs", "shared ranges", "all crowded"])
def test_substrings_do_not_depend_on_the_deal(spark, monkeypatch, setting):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    common, rows = text(25)[:110], []
    for i in range(150):
        rows.append((i, f"{text(rng.randint(5, 60))} {common[rng.randrange(8):]} {text(rng.randint(5, 60))}{'-' * rng.randrange(250)}{text(9)}"))
    rows += [(200 + i, rows[0][1]) for i in range(40)] + [(300, "z" * 70_000), (301, None), (None, rows[3][1]), (302, "a\0" * 90 + "b"), (303, "c" + "a\0" * 90)]
    if setting == "short runs":
        monkeypatch.setattr(substrings, "RUN", 700)
    if setting == "shared ranges":
        monkeypatch.setattr(substrings, "RANGES", 3)
        monkeypatch.setattr(substrings, "MERGER_BYTES", 4000)
    if setting == "all crowded":
        plain = substrings.Route.__init__

        def crowded(self, sample, mergers):
            plain(self, sample, mergers)
            self.crowded = set(sample)

        monkeypatch.setattr(substrings.Route, "__init__", crowded)
        monkeypatch.setattr(substrings, "SAMPLE_GRAMS", 1000)
    got = {r.doc_id: tuple(r) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").withColumn("first", F.lit(1))).collect()}
    assert got.pop(None)[2] == 0
    assert got == brute_cut([r for r in rows if r[0] is not None])


def test_substrings_at_larger_size(spark):
    big = "/root/testdata/sf0.01"
    want = brute_cut([(r.doc_id, r.text) for r in documents(spark, big).collect()])
    assert {r.doc_id: tuple(r) for r in queries.op6_suffix_dedup(spark, big).collect()} == want


def test_loser_tree_knows_its_prefixes():
    rng = random.Random(9)
    for _ in range(60):
        runs = []
        for _ in range(rng.randint(1, 9)):
            s = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 20)))
            runs.append((s, [0] + [substrings.common(a, b, 0) for a, b in zip(s, s[1:])]))
        merged = substrings.merge_runs(runs)
        out = [runs[r][0][i] for r, i, _ in merged]
        assert out == sorted(x for s, _ in runs for x in s)
        assert [h for *_, h in merged][1:] == [substrings.common(a, b, 0) for a, b in zip(out, out[1:])]


# --- exact top k ----------------------------------------------------------------------------------------


def test_bit_slices_are_exact():
    rng = np.random.default_rng(0)
    for n, d in ((1, 3), (70, 5), (200, 16)):
        values = rng.integers(-1500, 1500, (n, d))
        values[: n // 3] = values[0]  # many ties
        ids = rng.permutation(n) * 3
        block = bitsliced.Block.load(bitsliced.Block(ids, values).dump())
        for q in range(0, n, 7):
            scores = values @ values[q]
            want = sorted(((-int(s), int(i)) for s, i in zip(scores, ids) if i != ids[q]))[:10]
            assert sorted((-s, i) for i, s in block.top(int(ids[q]), values[q], 10)) == want


def test_top_k_corner_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, None]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [2.0, 1.0]), (6, [2.0, 1.0]), (100, [1.0]), (200, [0.5, -0.5]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = sorted(tuple(r) for r in bitsliced.top_k(df, F.col("vec_id") % 100 == 0, 10, block=2).collect())
    m = 1 << 20
    assert got == [(0, 1, 5, 4 * m), (0, 2, 6, 4 * m), (0, 3, 200, -m // 2), (200, 1, 5, m // 2), (200, 2, 6, m // 2), (200, 3, 0, -m // 2)]
    assert bitsliced.top_k(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []


# --- packing --------------------------------------------------------------------------------------------


def check_packing(got, rows, capacity=packing.CAPACITY):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(packing.default_vocabulary())
    want = Counter()
    for doc, text in rows:
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want.update((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r.length for r in got) // capacity)


def test_packing(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf_dir).collect()]
    n, least = check_packing(queries.op8_packing(spark, sf_dir).collect(), rows)
    assert n <= least + 1


def test_packing_corner_cases(odd_clashing, none):
    n, least = check_packing(packing.pack(odd_clashing).collect(), [(r[0], r[1]) for r in ODD])
    assert n <= least + 1
    assert packing.pack(none).collect() == []


def test_genetic_steps_keep_every_length():
    rng = random.Random(0)
    lengths = [rng.randint(1, 900) for _ in range(300)]
    for p in packing.evolve(lengths, 1000, 5, [])[0]:
        assert Counter(x for b in p for x in b) == Counter(lengths) and max(map(sum, p)) <= 1000
    a, b = packing.best_fit(lengths, 1000), packing.best_fit(sorted(lengths), 1000)
    child = packing.crossover(a, b, Counter(lengths), 1000, rng)
    assert Counter(x for c in child for x in c) == Counter(lengths)
    assert packing.load(packing.dump(child)) == child


def test_token_ids_are_those_of_the_file():
    from tokenizers import Tokenizer

    coder, plain = packing.Encoder(packing.default_vocabulary()), Tokenizer.from_file(packing.default_vocabulary())
    special = coder.ids("a <|endoftext|> b")
    assert len(special) == 5 and zlib.crc32(special.tobytes()) == 1893987649
    rng = random.Random(8)
    parts = ["<|endoftext|>", " ", "\n\n", "  x", "don't", "é", "🙂", "12 345", "\t", "<|end", "of", "!!", "的", "\u2028", "\x00", "\x85"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 30)))
        assert coder.ids(text).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 0]


def test_crossover_beats_best_fit():
    rng, lengths = random.Random(3), []
    for _ in range(60):  # three pieces fill a sequence, so sixty sequences are enough
        a = rng.randint(380, 490)
        b = rng.randint((1000 - a) // 2, 750 - a)
        lengths += [a, b, 1000 - a - b]
    start = packing.evolve(lengths, 1000, 1, [], generations=0)[0]
    best, bred = packing.evolve(lengths, 1000, 1, [])
    assert bred > 0 and 60 <= len(best[0]) < len(start[0]) <= len(packing.best_fit(sorted(lengths, reverse=True), 1000))


def test_migration_and_generations_are_reported(spark, monkeypatch):
    lengths = [(k, 340 + k % 3) for k in range(90)]  # no two sequences of 1000 can be full
    monkeypatch.setattr(packing, "pieces", lambda docs, vocabulary, capacity: spark.createDataFrame([(d, 0, 0, n, 0) for d, n in lengths], "doc_id long, piece int, start long, length long, ids_crc32 long"))
    got = packing.pack(None, "", 1000).collect()
    assert len({r.generations for r in got}) == 1 and got[0].generations >= packing.ISLANDS * packing.EPOCHS * packing.PATIENCE
    assert Counter((r.doc_id, r.length) for r in got) == Counter(lengths)


# --- languages ------------------------------------------------------------------------------------------


def test_language_held_out(spark):
    big = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in documents(spark, big).collect()}
    got = queries.op9_language_id(spark, big).collect()
    held = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert len(got) == 1000 and sum(held) / len(held) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)


def test_forward_sums_all_segmentations():
    pieces = language_id.Pieces([b"a", b"b", b"ab", b"aba", b"ba"])
    p = np.array([[0.3, 0.1], [0.2, 0.2], [0.25, 0.3], [0.05, 0.2], [0.2, 0.2]])
    model = language_id.Model(pieces, p)

    def total(word, k):
        return 1.0 if not word else sum(p[n, k] * total(word[len(x) :], k) for x, n in pieces.items() if word.startswith(x))

    words = [b"a", b"ab", b"abab", b"babab", b"aabba"]
    got = np.exp(model.log_words(words))
    want = np.array([[total(w, k) for k in (0, 1)] for w in words])
    assert np.allclose(got, want, rtol=1e-9) and np.allclose(np.exp([model.long_word(w) for w in words]), want, rtol=1e-9)
    uses = model.expected(Counter({b"aba": 2}), 0)
    z = total(b"aba", 0)
    assert np.isclose(uses[3], 2 * p[3, 0] / z) and np.isclose((uses * [1, 1, 2, 3, 2]).sum(), 6)


def test_all_pieces_take_part_and_words_of_any_length_agree(monkeypatch):
    table = language_id.load_pieces(language_id.default_vocabulary())
    assert len(table) == 50_256
    rng = np.random.default_rng(4)
    p = rng.random((len(table), 3)) ** 30 + 1e-15  # spread over many powers of ten, as in a large corpus
    model = language_id.Model(table, p / p.sum(0))
    memo = {}

    def total(word, k):
        if (word, k) not in memo:
            hits = [(table[word[:j]], word[j:]) for j in range(1, len(word) + 1) if word[:j] in table]
            memo[word, k] = np.logaddexp.reduce([model.log_p[n, k] + total(rest, k) for n, rest in hits]) if word else 0.0
        return memo[word, k]

    some = sorted((x for x in table if x[:1] == b" " and len(x.split()) == 1 and x[1:].split() == [x[1:]]), key=len)
    words = some[::900] + some[-8:] + [b" unladenswallow", "été".encode(), bytes(range(200, 224)), b" " + b"abcdefgh" * 20]
    want = np.array([[total(w, k) for k in range(3)] for w in words])
    assert max(map(len, some)) > language_id.TOGETHER - 10 and np.allclose(model.log_words(words), want, rtol=1e-9, atol=0)
    long_uses = model.expected(Counter({words[-1]: 3, words[5]: 1}), 1)
    monkeypatch.setattr(language_id, "TOGETHER", 1000)
    assert np.allclose(model.log_words(words), want, rtol=1e-9, atol=0)
    assert np.allclose(model.expected(Counter({words[-1]: 3, words[5]: 1}), 1), long_uses, rtol=1e-9, atol=1e-12)
    lengths = np.array(list(map(len, table)))
    assert np.isclose((long_uses * lengths).sum(), 3 * len(words[-1]) + len(words[5]))

    low = language_id.Model(table, np.tile([[5e-15, 1e-15]], (len(table), 1)) * (lengths == 1)[:, None] + 1e-300)
    unseen = bytes(range(200, 224))  # 24 bytes: far beyond the smallest number that a product could hold
    monkeypatch.undo()
    for w in (unseen, unseen + unseen):
        assert np.allclose(low.log_words([w])[0], len(w) * np.log([5e-15, 1e-15]), rtol=1e-9)


def test_language_brute_force(spark):
    """Training and prediction end to end, with every step written out over dictionaries."""
    rows = [(1, "the house the tree", "en"), (2, "das haus der baum", "de"), (3, "a tree", "en"), (4, "haus", None), (5, "treehouse hausbaum", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, model = language_id.train(docs, F.lit(True))
    table = language_id.load_pieces(language_id.default_vocabulary())
    p = {k: np.full(len(table), 1 / len(table)) for k in langs}

    def paths(word):
        return [[]] if not word else [[table[word[:j]], *rest] for j in range(1, len(word) + 1) if word[:j] in table for rest in paths(word[j:])]

    for _ in range(language_id.STEPS):
        for k in langs:
            c = np.full(len(table), language_id.SMOOTH)
            for _, text, lang in rows:
                for word in text.split() if lang == k else ():
                    every = paths(b" " + word.encode())
                    weight = np.array([np.prod(p[k][x]) for x in every])
                    for x, w in zip(every, weight / weight.sum()):
                        np.add.at(c, x, w)
            p[k] = c / c.sum()
    assert np.allclose(model.p, np.stack([p[k] for k in langs], 1), rtol=1e-9)
    for r in language_id.predict(docs, langs, model).collect():
        total = [sum(np.log(sum(np.prod(p[k][x]) for x in paths(b" " + w.encode()))) for w in r.row.text.split()) for k in langs]
        share = np.exp(np.array(total) - max(total))
        assert r.lang_pred == langs[int(np.argmax(total))] and np.isclose(r.score, share.max() / share.sum())


def test_language_corner_cases(odd, none):
    langs, model = language_id.train(odd, F.lit(True))
    assert langs == ["en", "fr"]
    got = {r.row.doc_id: (r.lang_pred, r.score) for r in language_id.predict(odd, langs, model).collect()}
    assert len(got) == len(ODD) - 1 and got[1] == got[2] == got[3] == ("und", 0.0) and got[9][0] == "fr"
    langs, model = language_id.train(none, F.lit(True))
    assert langs == [] and {r.lang_pred for r in language_id.predict(odd, langs, model).collect()} == {"und"}


# --- mixing ---------------------------------------------------------------------------------------------


def test_mixing_targets(spark):
    rows = [(i, "w " * (i % 7 + 1), "en", f"s{i % 5}" if i % 11 else None, 1) for i in range(4000)] + [(9000, "w " * 50, "en", "tiny", 1)]
    got = mixing.mixed(spark.createDataFrame(rows, SCHEMA)).collect()
    total = sum(r.size for r in got)
    target = {r.row.source: r.target for r in got}
    size = {r.row.source: r.source_size for r in got}
    assert abs(sum(target.values()) - total) < 1e-6 * total and all(target[s] <= 3 * size[s] + 1e-6 for s in size)
    names = sorted(s for s in size if s is not None) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    free = [target[s] / weight[s] for s in names if target[s] < 3 * size[s] - 1e-6]
    assert max(free) - min(free) < 1e-6 * max(free)
    assert all(3 * size[s] / weight[s] <= max(free) + 1e-6 for s in names if target[s] >= 3 * size[s] - 1e-6)
    for s in names:
        taken = sum(r.size * r.copies for r in got if r.row.source == s)
        assert abs(taken - target[s]) < 0.1 * target[s] + 30
    assert all(r.copies <= 3 for r in got)


def test_mixing_of_many_sources(spark, monkeypatch):
    rows = [(i, "w " * (i % 13), "en", f"host{i % 700}" if i % 3 else "hot", 1) for i in range(6000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(str, mixing.mixed(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 10)
    assert sorted(map(str, mixing.mixed(docs).collect())) == want and len(want) == 6000
    rates = mixing.source_rates(docs.select("source", mixing.word_count(F.col("text")).alias("size")))
    plain = sorted((r.source, r.source_size) for r in rates.collect())
    assert len(plain) == 701 and abs(sum(r.target for r in rates.collect()) - sum(n for _, n in plain)) < 1e-3


def test_mixing_corner_cases(odd_clashing, none):
    got = mixing.mixed(odd_clashing).collect()
    assert len(got) == len(ODD) and all(r.copies is not None for r in got)
    out = mixing.emit(odd_clashing)
    assert out.columns == odd_clashing.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.emit(odd_clashing).collect()))
    assert mixing.mixed(none).collect() == []
