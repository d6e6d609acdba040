"""Operators on whole corpora, against brute force on small tables with nulls, ties and clashing columns."""

import hashlib
import random
from collections import Counter

from regionweave.llm import exact, linededup, mixing, nearjoin, sketch
from regionweave.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, rep string"
ODD = [(1, None), (2, ""), (None, "same text here"), (3, "same text here"), (3, "same text here"), (4, "x y"), (5, " x  y "), (6, "word " * 400)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 2}" if i != 6 else None, len(t or ""), "k", None) for i, t in rows], SCHEMA)


def test_exact_duplicates(spark):
    got = exact.duplicates(frame(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = Counter(t or "" for _, t in ODD)
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in by}
    for r in got:
        t = sha[r.text_sha256]
        assert r.group_size == by[t] and r.keep_id == max((i for i, x in ODD if (x or "") == t and i is not None), default=None)
    assert Counter(sha[r.text_sha256] for r in got if r.kept) == Counter(set(by))
    kept = exact.deduplicate(frame(spark, ODD))
    assert kept.columns == frame(spark, ODD).columns and sorted((r.text or "") for r in kept.collect()) == sorted(by)
    odd = frame(spark, ODD).selectExpr("*", "1 as id_", "2 as was_", "'mine' as sha_", "4 as nth_", "5 as verdict", "6 as gone_id")
    for kept in (exact.deduplicate(odd), nearjoin.keep_one(odd)):
        assert kept.columns == odd.columns and {x.sha_ for x in kept.collect()} == {"mine"}
    assert exact.duplicates(frame(spark, ODD).limit(0)).count() == 0


def _mix_by_hand(rows, block):
    """Words taken of each row by the schedule, written out one slot after another."""
    size = [len((t or "").split()) for _, t, _ in rows]
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    have = {s: sum(n for n, (*_, x) in zip(size, rows, strict=True) if x == s) for s in sources}
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(sources)}
    goal, free, left = {}, set(sources), 1.5 * sum(have.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if 2 * have[s] < level * weight[s]}
        for s in over or free:
            goal[s] = 2.0 * have[s] if over else level * weight[s]
            left -= goal[s]
        free -= over or free
    place = lambda i: hashlib.md5(f"mix:{rows[i][0] if rows[i][0] is not None else 'null:' + hashlib.md5((rows[i][1] or '').encode()).hexdigest()}".encode()).hexdigest()
    line = {s: [i for i in sorted(range(len(rows)), key=lambda i: (place(i), rows[i][0] or 0, size[i])) if rows[i][2] == s for _ in range(size[i])] for s in sources}
    words = {s: int(g + 0.5) for s, g in goal.items()}
    total, taken, drawn = sum(words.values()), Counter(), Counter()
    for slot in range((total + block // 2) // block):
        point = (2 * (slot * mixing.GOLDEN % mixing.GRID) + 1) / (2 * mixing.GRID)
        low = 0
        for s in sources:
            if low / total <= point < (low + words[s]) / total:
                blocks = -(-have[s] // block)
                if drawn[s] < 2 * blocks:
                    at = (drawn[s] % blocks * (mixing.STEPS[0] % blocks) + blocks // 2) % blocks
                    taken.update(line[s][at * block : (at + 1) * block])
                drawn[s] += 1
            low += words[s]
    return goal, [(i, s, n, round(goal[s], 6), taken[k]) for k, ((i, _, s), n) in enumerate(zip(rows, size, strict=True))]


def test_mixing(spark):
    r = random.Random(5)
    rows = [(i, "w " * r.randint(0, 60), f"s{i % 4}" if i % 4 else None) for i in range(300)] + [(900, "w w", "s1"), (900, "w w", "s1"), (None, "a b c", "s2"), (901, None, "s2"), (902, "long " * 900, "s3"), (903, "", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "doc_id as id_", "1 as times_", "'x' as mix", "2 as nth", "3 as slot")
    key = lambda x: tuple(map(str, x))
    seen = lambda d: sorted(((x.doc_id, x.source, x.size, round(x.target, 6), x.taken) for x in d.collect()), key=key)
    goal, want = _mix_by_hand(rows, 16)
    assert seen(mixing.mix(df, block=16)) == sorted(want, key=key) == seen(mixing.mix(df.repartition(3), block=16))
    assert all(0 <= t <= 2 * n for _, _, n, _, t in want)
    for s, g in goal.items():
        assert abs(sum(t for _, x, _, _, t in want if x == s) - g) <= 3 * 16
    # the schedule's blocks are what is taken, and they interleave the sources
    spans = mixing.spans(df, block=16).collect()
    assert sum(x.end - x.begin for x in spans) == sum(t for *_, t in want)
    by_slot = {x.slot: x.source for x in spans}
    half = Counter(s for k, s in by_slot.items() if k < len(by_slot) / 2)
    assert all(abs(half[s] * 2 - n) <= 6 for s, n in Counter(by_slot.values()).items())
    out = mixing.apply_mix(df, block=16)
    assert out.columns == df.columns
    copies = Counter((x.doc_id, x.source, x.text) for x in out.collect())
    firsts = Counter((x.doc_id, x.source) for x in spans if x.begin == 0)
    for (i, t, s), n in Counter(rows).items():
        assert copies[i, s, t] == (n if not (t or "").split() else firsts[i, s])
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.apply_mix(df.limit(0)).count() == 0


def _shingles(t):
    w = (t or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_sketches(spark):
    rows = sorted([(i, t) for i, t in ODD if i is not None and (i, t) != (3, "same text here")] + [(3, "same text here"), (9, " ".join(map(str, range(300))))], reverse=True)
    got = {r.doc_id: r for r in sketch.fingerprints(frame(spark, rows)).collect()}
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[1].fingerprint == got[2].fingerprint and got[9].near_edited > 0.55
    assert sketch.fingerprints(frame(spark, [(1, "a"), (1, "a"), (None, None)])).count() == 3
    nameless = sketch.with_next(frame(spark, [(None, f"text {i}") for i in range(40)] + [(5, "five")]).select("doc_id", "text")).collect()
    follows = {x.text: x.next_text for x in nameless}
    assert len(follows) == 41 and set(follows.values()) == set(follows) and follows["five"] != "five"
    walk = "five"
    for _ in range(41):
        walk = follows[walk]
    assert walk == "five"
    assert sketch.fingerprints(frame(spark, rows).limit(0)).count() == 0


def test_sketch_likeness_equals_sets_of_kept_hashes(spark):
    from pyspark.sql import functions as F

    r = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(30):
        text = [r.choice(words) for _ in range(r.choice([0, 1, 4, 5, 30, 300]))]
        rows.append((i, "\t ".join(text + rows[-1][1].split()[: r.randint(0, 200)] if rows else text)))
    df = frame(spark, rows)
    got = {x.doc_id: x for x in sketch.fingerprints(df).collect()}

    def kept(t):
        """Shingles by hand; their hashes from the engine's own hash of an array of words."""
        return {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t.split() else set()

    every = sorted({s for k, (_, t) in enumerate(rows) for u in (t, t[: len(t) - len(t) // 3] + rows[k - 1][1][: len(t) // 3]) for s in kept(u)})
    hashed = {tuple(x.w): x.h for x in spark.createDataFrame([(list(s),) for s in every], "w array<string>").select("w", F.xxhash64("w").alias("h")).collect()}
    low = {s for s, h in hashed.items() if (h & (1 << 64) - 1) >> (64 - sketch.SCALE_BITS) == 0}

    def like(a, b):
        x, y = kept(a) & low, kept(b) & low
        return len(x & y) / min(len(x), len(y)) if x and y else float(a == b)

    for k, (i, t) in enumerate(rows):
        nxt = rows[k - 1][1]
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        assert abs(got[i].near_next - like(t, nxt)) < 1e-12 and abs(got[i].near_edited - like(t, edited)) < 1e-12
        marks = "".join(f"{(hashed[s] >> 14) & 0xFFFFFFFFFFFF:012x}" for s in sorted(kept(t) & low, key=hashed.get))
        assert got[i].fingerprint == hashlib.md5(t.encode()).hexdigest() + ":" + marks
    # the sketch of two texts together is the union of theirs
    a, b = (F.lit(rows[k][1]) for k in (5, 6))
    both = df.limit(1).select(sketch.merged(sketch.kept_hashes(a), sketch.kept_hashes(b)).alias("m")).first().m
    assert sorted(both) == sorted({hashed[s] for k in (5, 6) for s in kept(rows[k][1]) & low})


def _classes(rows):
    sets, parent, links = [_shingles(t) for _, t in rows], list(range(len(rows))), Counter()
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and common * 5 >= 4 * (len(sets[a]) + len(sets[b]) - common):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    low = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            low[find(x)] = min(low.get(find(x), i), i)
    return [(i, low.get(find(x)), links[x]) for x, (i, _) in enumerate(rows)]


def test_near_join_with_a_crowd(spark, monkeypatch):
    monkeypatch.setattr(nearjoin, "SPREAD_ROWS", 40)  # several blocks
    r = random.Random(2)
    base = [str(r.random()) for _ in range(90)]
    crowd = []
    for i in range(170):  # more than one block, and more than are compared within a band
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(90)] = str(r.random())
        crowd.append((100 + i, " ".join(w)))
    rows = [*ODD, *crowd, (400, " ".join(base[:85])), (401, " ".join(str(r.random()) for _ in range(50)))]
    got = nearjoin.join(frame(spark, rows)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or 0, x[2])
    assert sorted((tuple(x) for x in got), key=key) == sorted(_classes(rows), key=key)
    kept = nearjoin.keep_one(frame(spark, rows))
    assert {x.doc_id for x in kept.collect()} == {i for i, c, _ in _classes(rows) if i == c}
    assert nearjoin.join(frame(spark, ODD).limit(0)).count() == 0


def test_pruning_keeps_likely_pairs():
    from math import comb

    for n, least in nearjoin.CUTS:
        lost = sum(comb(n, m) * 0.8**m * 0.2 ** (n - m) for m in range(least))
        assert lost < 1e-5


def test_components(spark):
    r = random.Random(4)
    links = [(i, i + 1) for i in range(0, 60)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(40)] + [(7, 7), (None, 3)]
    got = {x.node: x.label for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61))
    for a, b in links:
        if a is not None and a != b:
            assert got[a] == got[b] <= min(a, b)


def test_line_templates(spark):
    note = "please visit page {} today for the newest offers of our shop near you"
    rows = [(i, f"own line of document {chr(97 + i) * 4} about things\n{note.format(i)}\n\nbye") for i in range(4)] + [(9, None), (10, ""), (11, "alone in here")]
    got = {r.doc_id: r for r in linededup.clean(frame(spark, rows)).collect()}
    for i in range(4):
        assert got[i].clean.split("\n")[-1] != "bye" and "offers" not in got[i].clean and got[i].n_dropped >= 2 and got[i].n_lines == 4
    assert got[9].clean is None and got[10].clean == "" and got[11].clean == "alone in here"
    assert linededup.clean(frame(spark, rows).limit(0)).count() == 0


def test_line_templates_with_fields_anywhere(spark):
    names, days = ["Alice", "Boris", "Chloe", "Dmitri"], ["Monday", "Tuesday", "Friday", "Sunday"]
    passage = " ".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60))
    rows = [(i, f"This page was last edited by {names[i]} on {days[i]} at the main office\nonly in {names[i]}") for i in range(4)]
    rows += [(10, passage), (11, f"before\n{passage}"), (12, passage.rsplit(" ", 20)[0]), (13, "Posted by someone at home"), (13, "Posted by someone at home"), (14, "Posted by someone at home")]
    got = {r.doc_id: r for r in linededup.clean(frame(spark, rows)).collect()}
    assert all(got[i].clean == f"only in {names[i]}" for i in range(4))
    assert got[10].clean == "" and got[11].clean == "before" and got[12].n_dropped == 0
    assert got[13].n_dropped == got[14].n_dropped == 0  # equal rows are one document


def test_registry_and_pipeline_shape():
    import corpus_pipeline
    from regionweave.llm import registry

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixture", "tokens"]
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
