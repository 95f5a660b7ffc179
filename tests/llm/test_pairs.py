"""Near copies, passages, benchmark items: against brute force."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from sessionloom.llm import chaining, minhash_bayes, qgram_bands
from sessionloom.llm.components import components


def words(seed: int, n: int) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7))) for _ in range(n)]


def edited(base: list[str], share: float, seed: int) -> list[str]:
    draw = random.Random(seed)
    return [f"e{draw.randint(0, 10**9)}" if draw.random() < share else w for w in base]


def brute_components(rows, width, percent):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    return {i: (len(sets[i]), root[i]) for i in sets}


@pytest.fixture(scope="module")
def family(spark):
    """A base and copies whose links to each other are often just under the threshold, strangers and short texts."""
    base = words(1, 150)
    rows = [(k, " ".join(edited(base, 0.022 + 0.002 * (k % 4), k))) for k in range(60)]
    rows += [(100 + k, " ".join(words(100 + k, 40))) for k in range(5)] + [(200, None), (201, ""), (202, "A b"), (203, "a B"), (204, rows[3][1])]
    return rows


def test_components_equal_brute_force(documents, family):
    want = brute_components(family, 4, 80)
    got = {r.doc_id: r for r in minhash_bayes.near_duplicates(documents(family, clash=True), 4, 80).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_strays_of_a_home_are_linked(spark, documents, family):
    """The last round alone finds the links between strays, and between strays and their home."""
    rows = [(i, t) for i, t in family if i < 30]
    docs = minhash_bayes.raw(documents(rows), "doc_id", "text")
    sigs = minhash_bayes.sketches(docs, 4).select("id", "sig")
    sets = minhash_bayes.shingle_blobs(docs, 4)
    placed = spark.createDataFrame([(1, i, i) for i, _ in rows], "band long, id long, root long")
    strays = spark.createDataFrame([(1, i, i, 0) for i, _ in rows if i], "band long, id long, root long, home long")
    links = minhash_bayes.links_in_homes(strays, placed, sigs, sets, 80)
    roots = {r.id: r.root for r in components(links).collect()}
    want = brute_components(rows, 4, 80)
    assert {i: roots.get(i, i) for i, _ in rows} == {i: root for i, (_, root) in want.items()}


def test_one_of_each_group_stays(documents, family, odd):
    kept = minhash_bayes.one_of_each(documents(family), 4).collect()
    want = brute_components(family, 4, 80)
    assert sorted(r.doc_id for r in kept) == sorted(i for i, (_, root) in want.items() if i == root)
    left = minhash_bayes.one_of_each(odd)
    assert left.columns == odd.columns and sum(r.doc_id is None for r in left.collect()) == 2
    assert minhash_bayes.near_duplicates(odd.limit(0)).count() == 0


def test_pruning_keeps_similar_signatures():
    draw = np.random.default_rng(3)
    left = draw.integers(0, 2**32, (400, minhash_bayes.HASHES), dtype=np.uint32)
    same = draw.random(left.shape) < 0.8
    assert len(minhash_bayes.undecided(left, np.where(same, left, left + 1), 0.8)) == 400
    assert len(minhash_bayes.undecided(left, left + np.uint32(1), 0.8)) == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(40)] + [(1000, 1000 + k) for k in range(1, 60)] + [(7, 7), (5000, 4999)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{1000 + k: 1000 for k in range(60)}, 5000: 4999, 4999: 4999}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shared_passages_are_found(documents, odd):
    passage = words(9, 70)
    rows = [(k, " ".join(words(50 + k, 80) + (passage if k < 4 else edited(passage, 0.03, k)) + words(90 + k, 60))) for k in range(6)]
    # A and B hold 30 words of another passage that two documents hold whole.
    other = words(10, 60)
    rows += [(20, " ".join(other[:30] + words(200, 60))), (21, " ".join(words(201, 40) + other)), (22, " ".join(words(202, 55) + other)), (30, " ".join(words(300, 400)))]
    found = chaining.passages(documents(rows, clash=True)).collect()
    named = {r.doc_id for r in found} | {r.ref_doc_id for r in found}
    assert named == {0, 1, 2, 3, 4, 5, 21, 22}
    text = dict(rows)
    for r in found:
        a, b = text[r.doc_id].split()[r.start : r.end], text[r.ref_doc_id].split()[r.ref_start : r.ref_end]
        assert len(a) >= 50 and (r.edits > 0 or a == b)
    assert chaining.passages(odd.limit(0)).count() == 0
    chaining.passages(odd).collect()


def test_chains_rise_and_skip_far_jumps():
    pos = [0, 4, 8, 12, 30, 34]
    assert chaining.chains(pos, [100, 104, 108, 112, 130, 134]) == [(0, 39, 100, 139)]
    assert len(chaining.chains(pos, [100, 104, 108, 112, 5, 9])) == 2


def matches(rows):
    """A batch of matches (document, partner, place, partner's place) in the order that the chaining step takes."""
    rows = sorted(rows, key=lambda r: (r[0], r[1], r[2] - r[3], r[2]))
    ids, refs, pos, ref = (list(c) for c in zip(*rows, strict=True))
    one = pa.array([1] * len(rows), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(ids), one, pa.array(refs), one, pa.array(pos, pa.int32()), pa.array(ref, pa.int32())], [*chaining.SIDES, "pos", "ref_pos"])


def test_runs_chain_as_their_matches_do():
    """A run enters the tree as one; its chain ends where the chain of its matches, taken one by one, does."""
    for seed in range(60):
        draw = random.Random(seed)
        rows, place = set(), 0
        for _ in range(40):
            place += draw.choice([1, 2, 3, 5, 8])
            rows.add((1, 2, place, place + 100 + (place > 90) * 3))
        batch = matches([*rows, *rows])
        got = [tuple(r.values())[4:] for b in chaining.chained()([batch]) for r in b.to_pylist()]
        one_by_one = sorted((p, r) for _, _, p, r in rows)
        assert sorted(got) == sorted(chaining.chains([p for p, _ in one_by_one], [r for _, r in one_by_one]))


def test_a_chain_takes_a_near_match_where_a_far_one_scores_more():
    pos = [*range(0, 40, 4), 60, 62]
    ref = [*range(100, 140, 4), 240, 242]
    # The run at 100 ends too far from the place 200; a single match beside it goes on.
    found = chaining.chains([*pos, 70], [*ref, 251])
    assert (60, 75, 240, 256) in found and (0, 41, 100, 141) in found


@pytest.mark.parametrize("cut", [1, 3, 7])
def test_batches_are_cut_between_documents(cut):
    whole = matches([(d, r, p, p + 50) for d in (1, 2, 3) for r in (8, 9) for p in range(0, 5 * d, 4)])
    parts = [whole.slice(b, cut) for b in range(0, whole.num_rows, cut)]
    for width in (1, 4):
        groups = [[r[:width] for r in zip(*(c.to_pylist() for c in b.columns), strict=True)] for b in chaining.whole_groups(parts, width)]
        assert sum(len(g) for g in groups) == whole.num_rows
        seen = [set(g) for g in groups]
        assert all(not a & b for i, a in enumerate(seen) for b in seen[:i])
    assert list(chaining.whole_groups([], 2)) == []


def test_word_edits():
    x = np.arange(60, dtype=np.uint32)
    assert chaining.reach(x, x, 3) == 0 and chaining.reach(x, np.delete(x, 20), 3) == 1
    y = np.insert(np.delete(x, 20), 40, 999).astype(np.uint32)
    assert chaining.reach(x, y, 3) == 2 and chaining.reach(x, x[::-1].copy(), 5) is None


def distance(pattern: str, text: str) -> int:
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_every_occurrence_within_the_budget_is_found():
    draw = random.Random(4)
    item = " ".join(words(70, 14))[: qgram_bands.WINDOW]
    windows = qgram_bands.Windows([(1, item)])
    noise = " ".join(words(71, 60))
    hits = 0
    for _ in range(150):
        text = list(item)
        for _ in range(draw.randint(0, 14)):
            p = draw.randrange(len(text))
            text[p : p + 1] = draw.choice([[], ["z"], [text[p], "z"]])
        whole = noise[:80] + "".join(text) + noise[80:]
        near = distance(item, whole) <= windows.budget[0]
        found = list(qgram_bands.find(windows, [None, whole, ""]))
        assert bool(found) == near
        hits += near
    assert 20 < hits < 150


def test_contaminated_rows_go(spark, documents, odd):
    item = " ".join(words(80, 40))
    items = spark.createDataFrame([(1, item), (2, None), (3, "short"), (None, " ".join(words(81, 30)))], "item_id long, text string")
    rows = [(1, "before " + item.upper() + " after"), (None, item), (2, " ".join(words(82, 100))), (3, None)]
    docs = documents(rows, clash=True)
    found = qgram_bands.contaminated(docs, items).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.start, r.end, r.edits) for r in found) == [(0, 1, 0, len(item), 0), (1, 1, 7, 7 + len(item), 0)]
    clean = qgram_bands.uncontaminated(docs, items)
    assert sorted(r.doc_id for r in clean.collect()) == [2, 3] and clean.columns == docs.columns
    assert qgram_bands.uncontaminated(odd, items).count() == odd.count() and qgram_bands.contaminated(docs, items.limit(0)).count() == 0


def passages_of(documents, rows):
    return [r.asDict() for r in chaining.passages(documents(rows)).collect()]


def test_passages_cover_all_equal_runs(documents):
    """Every run of 60 words shared with another text lies in passages, up to a few words at its ends that only another holder shares."""
    draw = random.Random(5)
    pool = [words(1000 + k, draw.randint(60, 160)) for k in range(12)]
    texts = {}
    for k in range(80):
        parts = [words(3000 + 7 * k, draw.randint(20, 90))]
        for _ in range(draw.randint(0, 3)):
            source = draw.choice(pool)
            cut = draw.randint(0, len(source) - 60)
            parts += [source[cut : cut + draw.randint(60, 160)], words(5000 + draw.randint(0, 10**6), draw.randint(5, 80))]
        texts[k] = [w for p in parts for w in p]
    runs: dict[tuple, list] = {}
    for k, text in texts.items():
        for i in range(len(text) - 59):
            runs.setdefault(tuple(text[i : i + 60]), []).append((k, i))
    want = {(k, i + j) for places in runs.values() if len({k for k, _ in places}) > 1 for k, i in places for j in range(60)}
    got = set()
    for r in passages_of(documents, [(k, " ".join(t)) for k, t in texts.items()]):
        got |= {(r["doc_id"], i) for i in range(r["start"], r["end"])} | {(r["ref_doc_id"], i) for i in range(r["ref_start"], r["ref_end"])}
        assert r["edits"] <= chaining.EDITS * (r["end"] - r["start"]) and r["end"] - r["start"] >= chaining.LEAST
    assert len(want) > 3000
    for places in runs.values():
        for k, i in places if len({k for k, _ in places}) > 1 else []:
            assert sum((k, i + j) in got for j in range(60)) >= 30
    assert len(want - got) <= 0.05 * len(want)
    # Beyond: shorter runs that two texts share, and a few words at the ends.
    assert len(got - want) <= 0.25 * len(got)


@pytest.mark.parametrize("rate,least", [(0.05, 58), (0.1, 57), (0.15, 54)])
def test_edited_passages_are_recalled(documents, rate, least):
    """Of 60 passages of 100 words with replaced words at least nine in ten, up to near the edit budget."""
    rows = []
    for k in range(60):
        base = words(200 + k, 100)
        rows.append((2 * k, " ".join(words(400 + k, 80) + base + words(600 + k, 70))))
        rows.append((2 * k + 1, " ".join(words(800 + k, 60) + edited(base, rate, k) + words(900 + k, 90))))
    pairs = {tuple(sorted((r["doc_id"], r["ref_doc_id"]))) for r in passages_of(documents, rows)}
    assert all(b == a + 1 and a % 2 == 0 for a, b in pairs) and len(pairs) >= least


def test_passages_without_a_first_seed_are_found(documents):
    """Edited passages none of whose shared windows has a key divisible by EVERY: the other windows lead to them."""
    rows, nth = [], 0
    while len(rows) < 8:
        nth += 1
        base = words(20_000 + nth, 60)
        changed = [f"x{nth}x{i}" if i % 10 == 9 else w for i, w in enumerate(base)]
        counts = [len(base)]
        keys = [set(chaining.seeds_of(chaining.word_keys([" ".join(t).encode()])[0], np.array(counts))[0].tolist()) for t in (base, changed)]
        if not keys[0] & keys[1]:
            k = len(rows)
            rows += [(k, " ".join(words(30_000 + k, 80) + base + words(31_000 + k, 40))), (k + 1, " ".join(words(32_000 + k, 30) + changed + words(33_000 + k, 90)))]
    found = passages_of(documents, rows)
    assert {(r["ref_doc_id"], r["doc_id"]) if r["ref_doc_id"] < r["doc_id"] else (r["doc_id"], r["ref_doc_id"]) for r in found} == {(k, k + 1) for k in (0, 2, 4, 6)}


def test_windows_meet_as_arrays(spark, documents):
    """Windows go to their shards in a row for each shard and batch, not one each; those that come back are the repeated ones, by brute force."""
    base = words(77, 90)
    rows = [(k, " ".join(words(40 + k, 30 + 9 * k) + (base if k % 3 else base[:50]) + words(60 + k, 20))) for k in range(12)] + [(12, " ".join(words(99, 49))), (13, ""), (14, None)]
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([5] * len(rows), pa.int64()), pa.array([t and t.encode() for _, t in rows], pa.binary())], ["id", "d", "text"])
    where = {}
    for k, text in rows:
        held = (text or "").split()
        for i in range(len(held) - chaining.SEED + 1) if len(held) >= chaining.LEAST else ():
            where.setdefault(tuple(held[i : i + chaining.SEED]), []).append((k, i))
    spots = sum(map(len, where.values()))
    dealt = list(chaining.packed(tuple(range(chaining.EVERY)), 7)([batch]))
    assert sum(b.num_rows for b in dealt) <= 7 and sum(len(x) for b in dealt for c in (4, 5, 6) for x in b.column(c).to_pylist()) <= 13 * spots
    want = sorted((s, min(group)) for group in where.values() if len(group) > 1 for s in group)
    texts = documents([r for r in rows if r[1] is not None]).selectExpr("doc_id AS id", "5L AS d", "CAST(text AS BINARY) AS text")
    for paired in (False, True):
        found = chaining.repeated_windows(texts, tuple(range(chaining.EVERY)), paired).collect()
        assert sorted((r.id, r.pos) for r in found) == [s for s, _ in want]
        if paired:
            assert sorted(((r.id, r.pos), (r.ref, r.ref_pos)) for r in found) == want


def test_a_key_of_many_batches_keeps_its_ends():
    """Partners by the first and last occurrence in each order, the same however the rows of a key are cut."""
    draw = random.Random(4)
    spots = sorted({(draw.randrange(5), draw.randrange(60), draw.randrange(9)) for _ in range(400)})
    ranks = {k: [draw.randrange(1 << 40) for _ in range(chaining.ORDERS)] for k in range(60)}
    rows = sorted([(*s, False) for s in spots] + [(*s, True) for s in spots if draw.random() < 0.5], key=lambda r: (r[0], r[3]))
    want = set()
    for h, k, i, asks in rows:
        for order in range(chaining.ORDERS) if asks else ():
            group = sorted((ranks[t][order], t, j) for g, t, j in spots if g == h)
            first, last = group[0][1:], group[-1][1:]
            here = first[0] == k and (last[0] == k and first[1] == i or last[0] != k)
            want |= {(k, i, *(last if here else first))} - {(k, i, k, i)}
    columns = [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([0] * len(rows)), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows])]
    columns += [pa.array([ranks[r[1]][order] for r in rows]) for order in range(chaining.ORDERS)]
    whole = pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])
    for cut in (3, 50, len(rows)):
        found = [r for b in chaining.others()(whole.slice(s, cut) for s in range(0, len(rows), cut)) for r in b.to_pylist()]
        assert {(r["id"], r["pos"], r["ref"], r["ref_pos"]) for r in found} == want


def held_in_parts(base: list[str], decoys: int, first: int) -> list[tuple[int, str]]:
    """Texts that hold all of ``base`` in pieces of 24 words, too short for a passage and far apart."""
    rows = []
    for k in range(decoys):
        order = random.Random(k).sample(range(0, len(base) - 23, 12), (len(base) - 24) // 12 + 1)
        rows.append((first + k, " ".join(w for n, cut in enumerate(order) for w in words(50_000 + 97 * k + n, 30) + base[cut : cut + 24])))
    return rows


def test_a_passage_among_many_holders_of_its_parts_is_found(documents):
    """Every window of the passage lies in 250 other texts, so that the one that shares all of it is hardly ever the first or last of them."""
    rows = []
    for k in range(2):
        base = words(40_000 + k, 60)
        rows += [(9000 + 2 * k, " ".join(words(41_000 + k, 40) + base + words(42_000 + k, 30))), (9001 + 2 * k, " ".join(words(43_000 + k, 20) + base + words(44_000 + k, 50)))]
        rows += [(i, t) for i, t in held_in_parts(base, 250, 1000 * (k + 1))]
    found = passages_of(documents, rows)
    assert {tuple(sorted((r["doc_id"], r["ref_doc_id"]))) for r in found} == {(9000, 9001), (9002, 9003)}
    assert all(r["end"] - r["start"] >= 58 for r in found)


def test_texts_that_go_on_in_a_period_are_passages(documents):
    """One word, two words or a line over and over: shared by two texts at other places, and in one text alone; rows that repeat change nothing."""
    tell = [["of"], ["is", "one"], words(45, 7), words(46, 30)]
    rows = []
    for k, unit in enumerate(tell):
        long = (unit * 200)[:200]
        rows += [(2 * k, " ".join(words(700 + k, 30) + long + words(710 + k, 20))), (2 * k + 1, " ".join(words(720 + k, 55) + long[:150] + words(730 + k, 20)))]
    rows += [(8, " ".join(words(740, 30) + ["solo"] * 160 + words(741, 20)))]
    covered: dict[int, set[int]] = {}
    for given in (rows, rows + rows):
        found = passages_of(documents, given)
        for r in found:
            covered.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
            covered.setdefault(r["ref_doc_id"], set()).update(range(r["ref_start"], r["ref_end"]))
        assert {(r["doc_id"], r["ref_doc_id"]) for r in found} >= {(2 * k + 1, 2 * k) for k in range(4)} | {(8, 8)}
        for k in range(4):
            assert len(covered[2 * k + 1] & set(range(55, 205))) >= 140 and len(covered[2 * k] & set(range(30, 230))) >= 145
        assert len(covered.pop(8) & set(range(30, 190))) >= 140
        covered.clear()


def test_all_holders_meet_by_document_as_they_do_by_key():
    """The documents that seeds are sent to give the passages that a row for each pair of a seed and a holder gives."""
    draw = random.Random(12)
    lines = [words(60_000 + k, draw.choice((9, 14, 25, 40))) for k in range(8)]
    texts = []
    for k in range(120):
        parts = [draw.choice((lines[draw.randrange(8)], edited(lines[draw.randrange(8)], 0.1, k), words(61_000 + 13 * k + n, draw.randint(1, 20)))) for n in range(9)]
        texts.append([w for p in parts for w in p])
    texts += [words(65_000 + k, 20) + ["of"] * (60 + k) + words(66_000 + k, 9) for k in range(3)]
    blobs = pa.array([" ".join(t).encode() for t in texts], pa.binary())
    ids, ds = pa.array(range(len(texts)), pa.int64()), pa.array([7] * len(texts), pa.int64())
    dealt = chaining.packed(tuple(range(chaining.EVERY)), 1)([pa.RecordBatch.from_arrays([ids, ds, blobs], ["id", "d", "text"])])
    table = pa.Table.from_batches(chaining.repeated(False)(dealt))
    runs = table.filter(pc.equal(table["nth"], 0))
    names = ["h", "id", "id", "d", "pos", "nth", "size", "step"]

    by_key = pa.concat_tables([pa.table([*(part[n] for n in names), pa.array([asks] * len(part))], ["h", "rank", "id", "d", "pos", "nth", "size", "step", "asks"]) for part, asks in ((runs, False), (table, True))])
    by_key = by_key.sort_by([("h", "ascending"), ("asks", "ascending"), ("rank", "ascending")]).combine_chunks()
    pairs = pa.Table.from_batches(chaining.answered(1 << 40)(by_key.to_batches()))
    pairs = pairs.append_column("diagonal", pc.subtract(pairs["pos"], pairs["ref_pos"])).sort_by([(n, "ascending") for n in ("id", "ref", "diagonal", "pos")])
    every = chaining.chained()(pairs.select([*chaining.SIDES, "pos", "ref_pos"]).combine_chunks().to_batches())

    def listed(part, asks):
        fields = ("id", "d", "pos", "h", "nth", "size", "step")
        windows = [[r | {"asks": asks} for r in part.filter(pc.equal(part["id"], k)).select(fields).to_pylist()] for k in range(len(texts))]
        kind = pa.list_(pa.struct([(n, table.schema.field(n).type) for n in fields] + [("asks", pa.bool_())]))
        return pa.Table.from_batches(chaining.beside([pa.RecordBatch.from_arrays([ids, blobs, pa.array(windows, kind)], ["own", "text", "windows"])]))

    asked, held = listed(table, True).sort_by("h"), listed(runs, False).combine_chunks().to_batches()
    seeds = {n: asked[n].to_numpy().astype(np.int64) for n in ("own", "pos", "h", "nth", "size", "step", "before", "after")} | {"document": asked["own"].to_numpy()}
    matches = list(chaining.tiled(seeds, ids, ds)(held))
    by_document = chaining.chained()(matches)

    def passages(chains):
        rows = [r | {"words": whole[r["id"]], "ref_words": [whole[r["ref"]][:400], whole[r["ref"]][400:]], "from": 0, "ref_from": 0} for b in chains for r in b.to_pylist()]
        kinds = {"words": pa.binary(), "ref_words": pa.list_(pa.binary())}
        columns = [pa.array([r[n] for r in rows], kinds.get(n, pa.int64())) for n in chaining.FIELDS]
        return {tuple(r.values()) for b in chaining.aligned([pa.RecordBatch.from_arrays(columns, list(chaining.FIELDS))]) for r in b.to_pylist()}

    whole = [chaining.word_keys([blob])[0].astype(np.uint32).tobytes() for blob in blobs.to_pylist()]
    want = passages(every)
    assert passages(by_document) == want and len(want) > 500
    assert sum(b.num_rows for b in matches) < len(pairs)


def test_equal_runs_at_once_and_by_diagonal(monkeypatch):
    draw = np.random.default_rng(8)
    x, y = draw.integers(0, 3, (2, 300), dtype=np.uint32)
    x[40:90], y[70:120], y[200:230] = 7, 7, x[100:130]
    at_once = chaining.equal_runs(x, y, 6, range(-80, 150))
    monkeypatch.setattr(chaining, "SMALL", 0)
    assert sorted(at_once) == sorted(chaining.equal_runs(x, y, 6, range(-80, 150))) and (30, 100, 100) in [(min(n, 30), i, d) for n, i, d in at_once if d == 100 and i == 100]


def test_ids_with_several_texts_lose_nothing(documents):
    rows = []
    for k in range(40):
        for side in (0, 1):
            base = words(2000 + 2 * k + side, 70)
            rows += [(k, " ".join(words(4000 + 2 * k + side, 30) + base)), (100 + 2 * k + side, " ".join(base + words(6000 + 2 * k + side, 40)))]
    found = passages_of(documents, rows)
    assert {max(r["doc_id"], r["ref_doc_id"]) for r in found} == set(range(100, 180)) and {min(r["doc_id"], r["ref_doc_id"]) for r in found} == set(range(40))


def test_a_partner_named_by_many(documents):
    """No row grows with the documents that share one passage; each of them is found."""
    licence = words(31, 90)
    n = 20_000
    rows = [(k, " ".join([f"w{k}a", f"w{k}b", *licence, f"w{k}c"])) for k in range(n)]
    found = passages_of(documents, rows)
    assert len({r["doc_id"] for r in found}) == n - 1 and {r["ref_doc_id"] for r in found} == {0}


def brute_items(rows, items):
    """Items (id, text) that a text holds whole, by row."""
    return sorted((i, item) for i, text in rows for item in {j for j, t in items if len(t) >= qgram_bands.Q and t in text})


def test_many_short_items(spark, documents):
    items = [(k, f"{chr(97 + k % 26)}{k:06d}{chr(97 + k // 26 % 26)} stop.") for k in range(200_000)]
    chosen = [0, 100, 87_381, 87_382, 119_990, 199_999]
    rows = [(k, "Some words before " + items[k][1] + " and after them") for k in chosen] + [(-1, "nothing of it in here at all")]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = qgram_bands.contaminated(documents(rows), table).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(k, k) for k in chosen]


def test_items_of_one_id_in_many_blocks(spark, documents, monkeypatch):
    monkeypatch.setattr(qgram_bands, "BLOCK_BYTES", 1 << 14)
    items = [(k % 30, " ".join(words(7000 + k, 30))) for k in range(300)]
    rows = [(k, " ".join(words(9000 + k, 20)) + " " + " ".join(t for j, t in items[k : k + 3])) for k in range(0, 290, 10)] + [(None, items[7][1] + " tail " + items[37][1])]
    found = qgram_bands.contaminated(documents(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(found) == len({(r.doc_id, r.item_id) for r in found})
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.item_id) for r in found) == brute_items([(-1 if i is None else i, t) for i, t in rows], items)
    both = next(r for r in found if r.doc_id is None)
    assert both.item_id == 7 and both.start == 0 and both.end == len(items[7][1] + " tail " + items[37][1]) and both.edits == 0
    clean = qgram_bands.uncontaminated(documents([*rows, (5, " ".join(words(12, 60)))]), spark.createDataFrame(items, "item_id long, text string"))
    assert [r.doc_id for r in clean.collect()] == [5]
