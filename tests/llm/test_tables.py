"""Dialogues, scores, mixes, codes and the pipeline: against brute force or exact round trips."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from sessionloom.llm import interpolation, mixture, perspectives, repair_codec
from sessionloom.llm.registry import ORACLES, QUERIES, load, vocabulary
from tests.oracle import connect, differences

PATH = vocabulary("word_bpe_49k.json")
load()


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
    assert "pipeline" in QUERIES and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, sf, name):
    assert differences(QUERIES[name](spark, sf), connect(sf), ORACLES[name]) == ""


TURNS = "conv_id long, turn long, role string, text string, participant string"


def rotated(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash") for r in rows], TURNS)
    return {(r.conv_id, r.participant, r.part): r for r in perspectives.rotate(df, **options).collect()}


def test_every_speaker_is_the_assistant_once(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo 🎉"), (1, 3, "ann", None), (1, 3, "ann", None), (1, None, None, "late")]
    got = rotated(spark, rows)
    assert set(got) == {(1, p, q) for p in ("ann", "bob") for q in (0, None)}
    ann = got[1, "ann", 0]
    assert ann.text == (
        "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n"
        "<|im_start|>user name=bob\nyo 🎉<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    )
    assert [ann.text[s["start"] : s["end"]] for s in ann["mask"]] == ["hi<|im_end|>", "<|im_end|>"] and (ann.n_turns, ann.n_own) == (4, 2)
    assert got[1, "bob", None].text == "<|im_start|>user\nlate<|im_end|>\n" and got[1, "bob", None]["mask"] == []


def test_parts_join_to_the_dialogue(spark):
    rows = [(None, k, "ab"[k % 2], f"m{k}") for k in range(10)] + [(2, 0, "system", "alone")]
    one, many = rotated(spark, rows), rotated(spark, rows, part_turns=3)
    assert {k[0] for k in one} == {None}
    for seat in "ab":
        parts = sorted((k[2], r.text) for k, r in many.items() if k[1] == seat)
        assert len(parts) == 4 and "".join(t for _, t in parts) == one[None, seat, 0].text
    assert rotated(spark, []) == {}


def brute_scores(rows):
    """Scores of a bigram model, word for word, from dictionaries."""
    tokens = [[w.decode() for w in (t or "").encode().lower().split()] + ["</s>"] for _, t in rows]
    fold = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 for i, _ in rows]

    def counts(skip):
        one, two, n = Counter(), Counter(), 0
        for t, f in zip(tokens, fold, strict=True):
            if f not in skip:
                one.update(t)
                two.update(zip(["<s>", *t], t))
                n += 1
        size = sum(one.values())
        context = lambda u: n if u == "<s>" else one[u]
        return size, len(one), one, two, context

    def weights(events):
        cells, out, last = defaultdict(Counter), [], 0.5
        for c, f, low in events:
            cells[int(math.log2(c))][round(64 * math.log2(f / low)) if f else None] += 1
        for b in range(64):
            if b in cells:
                total = sum(cells[b].values())
                for _ in range(interpolation.ROUNDS):
                    last = sum(n * last * 2 ** (k / 64) / (last * 2 ** (k / 64) + 1 - last) for k, n in cells[b].items() if k is not None) / total
                    last = min(max(last, 1e-6), 1 - 1e-6)
            out.append(last)
        return out

    size, types, one, two, context = counts({2, 3})
    dev = [t for t, f in zip(tokens, fold, strict=True) if f == 3]
    w1 = weights((size, one[w] / size, 1 / (types + 1)) for t in dev for w in t if size)

    def low(w, size, types, one):
        a = w1[int(math.log2(size))] if size else 0.0
        return a * one[w] / max(size, 1) + (1 - a) / (types + 1)

    w2 = weights((context(u), two[u, w] / context(u), low(w, size, types, one)) for t in dev for u, w in zip(["<s>", *t], t) if context(u))
    size, types, one, two, context = counts({2})
    out = []
    for (i, _), t, f in zip(rows, tokens, fold, strict=True):
        score = 0.0
        for u, w in zip(["<s>", *t], t):
            c = context(u)
            a = w2[int(math.log2(c))] if c else 0.0
            score += math.log10((a * two[u, w] / c if c else 0.0) + (1 - a) * low(w, size, types, one))
        base = sum(math.log10((one[w] + 1) / (size + types + 1)) for w in t)
        out.append((-1 if i is None else i, f == 2, len(t), sum(one[w] > 0 for w in t), size, round(base, 6), round(score, 6)))
    return sorted(out)


def test_scores_equal_brute_force(documents, odd):
    draw = np.random.default_rng(5)
    rows = [(k, " ".join(f"W{int(n)}" for n in draw.zipf(1.5, int(draw.integers(0, 80))) if n < 500)) for k in range(80)]
    rows += [(None, None), (None, "w1 w2"), (81, ""), (7, rows[7][1])]
    for table in (rows, [(3, "a b")], [(r.doc_id, r.text) for r in odd.collect()]):
        got = interpolation.fit_and_score(documents(table, clash=True)).collect()
        found = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got)
        assert found == brute_scores(table)
    assert interpolation.fit_and_score(odd.limit(0)).count() == 0


def test_probabilities_sum_to_one():
    """Over all words after one context, the unknown word included."""
    counts = np.array([[5, 3, 2, 0], [3, 1, 0, 0]])
    model = interpolation.Mixture(10, 3, 4, [np.full(64, 0.7), np.full(64, 0.4)])
    total = sum(model.probabilities(np.array([[4, a], [0, b]]), 2)[1] for a, b in counts.T)
    assert total == pytest.approx(1.0)


def test_packing_round_trips():
    draw = np.random.default_rng(1)
    for values in ([], [0], [1, 255], [256, 70_000], [1 << 40]):
        assert interpolation.unpacked(interpolation.packed(np.array(values, dtype=np.int64))).tolist() == values
    for n in (0, 1, 2, 100_000):
        keys = np.unique(draw.integers(0, 2**63, n, dtype=np.uint64))
        assert (interpolation.unpacked_keys(interpolation.packed_keys(keys)) == keys).all()


def test_targets_fill_up():
    assert mixture.water_filled([100, 100, 100], [3, 1, 2]) == [200.0, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mixture.water_filled([0, 10], [3, 1]) == [0.0, 15.0] and mixture.water_filled([], []) == []


def test_permutations():
    for n in (1, 2, 3, 10, 1000):
        assert sorted(mixture.permuted(np.arange(n), n, 5).tolist()) == list(range(n))


def test_mix_takes_its_targets(documents, odd):
    draw = np.random.default_rng(2)
    rows = [(k, " ".join("w" * int(draw.integers(1, 9)) for _ in range(int(draw.integers(0, 400)))), [None, "a", "b", "c"][min(k % 9, 3)]) for k in range(300)]
    docs = documents(rows, clash=True)
    got = {r.doc_id: r for r in mixture.mixed_sizes(docs).collect()}
    assert got == {r.doc_id: r for r in mixture.mixed_sizes(docs.repartition(7)).collect()}
    sums, source = Counter(), {i: s for i, _, s in rows}
    for i, r in got.items():
        sums[source[i]] += r.taken
        assert r.size == len(rows[i][1].split()) and r.taken <= 2 * r.size
    for i, r in got.items():
        assert abs(sums[source[i]] - r.target) <= 0.05 * r.target + 2 * mixture.BLOCK
    assert sum({source[i]: r.target for i, r in got.items()}.values()) == pytest.approx(1.5 * sum(r.size for r in got.values()))
    words, text = Counter(), {i: t for i, t, _ in rows}
    for r in mixture.mixed_documents(docs).collect():
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text) and r.key == "x" and r.text.split()[0] in text[r.doc_id]
    assert all(words[i] == r.taken for i, r in got.items())
    assert mixture.mixed_sizes(odd).count() == odd.count() and mixture.mixed_documents(odd).columns == odd.columns
    assert mixture.mixed_sizes(odd.limit(0)).count() == 0 and mixture.mixed_documents(odd.limit(0)).count() == 0


def brute_mix(rows, block, slots, seed):
    """What the mix takes of every (id, text, source) row, slot by slot in plain Python."""
    by = defaultdict(list)
    for i, text, source in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        by[(source is None, source or "")].append((i, len((text or "").split())))
    names = sorted(by)
    sizes = [sum(n for _, n in by[s]) for s in names]
    targets = mixture.water_filled(sizes, [(3, 1, 2)[k % 3] for k in range(len(names))])
    filled = [k for k in range(len(names)) if targets[k] > 0]
    wanted = [targets[k] / block for k in filled]
    goal = [math.floor(w) for w in wanted]
    for k in sorted(range(len(wanted)), key=lambda k: goal[k] - wanted[k])[: round(sum(wanted)) - sum(goal)]:
        goal[k] += 1
    # Every slot of every shard, as drawn, then those past a goal to the sources that lack some.
    drawn, shard = [0] * len(goal), 0
    while shard * slots < sum(goal):
        room = min(slots, sum(goal) - shard * slots)
        drawn = [a + int(b) for a, b in zip(drawn, np.random.default_rng([seed, shard]).multinomial(room, np.array(goal) / sum(goal)), strict=True)]
        shard += 1
    assert sum(drawn) == sum(goal)
    taken = Counter()
    for place, k in enumerate(filled):
        words = [i for i, n in by[names[k]] for _ in range(n)]
        blocks = [words[b : b + block] for b in range(0, len(words), block)]
        for j in range(goal[place]):
            turn, n = divmod(j, len(blocks))
            key = int(mixture.mix(np.array([seed * 1000003 + place * mixture.PASSES + turn], dtype=np.uint64))[0])
            taken.update(blocks[int(mixture.permuted(np.array([n]), len(blocks), key)[0])])
    of = {i: (sizes[k], targets[k]) for k, s in enumerate(names) for i, _ in by[s]}
    return {i: (len((t or "").split()), *of[i], taken[i]) for i, t, _ in rows}


@pytest.mark.parametrize("block,slots", [(8, 16), (64, 4096)])
def test_mix_equals_brute_force(documents, block, slots):
    draw = np.random.default_rng(6)
    names = ["b", "a", None, "Z", "é"]
    rows = [(k, None if k == 3 else " ".join(["w"] * int(draw.integers(0, 120))), names[min(int(draw.integers(0, 9)), 4)]) for k in range(200)]
    got = {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in mixture.mixed_sizes(documents(rows, clash=True), block=block, slots=slots).collect()}
    want = brute_mix(rows, block, slots, mixture.SEED)
    assert got == {i: (n, s, pytest.approx(t), k) for i, (n, s, t, k) in want.items()}


def test_drawn_slots_settle_on_their_targets():
    targets, drawn = np.array([5, 3, 4]), np.array([8, 1, 3])
    settled = mixture.Settled(targets, drawn)
    got = Counter()
    for number, pieces in ((0, (0, 3, 5, 8)), (1, (0, 1)), (2, (0, 2, 3))):
        for first, last in zip(pieces, pieces[1:], strict=False):
            for taker, slots in settled.slots(number, first, last - first):
                got.update((taker, int(j)) for j in slots)
    assert got == Counter({(k, j): 1 for k, n in enumerate(targets.tolist()) for j in range(n)})


def test_mixed_texts_keep_their_white_space(documents):
    text = "\n\n".join(f"Para {k} has  two blanks\tand a tab." for k in range(400))
    rows = mixture.mixed_documents(documents([(1, text, "s")])).collect()
    # Stretches begin and end at blocks; a line end parts those that do not follow each other.
    assert rows and all(part in text for r in rows for part in r.text.split("\n"))
    assert any("  two blanks\tand" in r.text and "\n\n" in r.text for r in rows)


def test_a_long_text_is_cut_once(documents):
    """Time grows with the text, not with the text times its pieces."""
    import time

    plan = mixture.mixed_documents(documents([(1, "a b c", "s")]))._jdf.queryExecution().optimizedPlan().toString()
    pieces = plan[plan.index("lambda"):] if "lambda" in plan else ""
    assert "regexp_extract_all" in plan and "slice(regexp_extract_all" not in pieces

    def seconds(n):
        docs = documents([(1, " ".join(f"w{k}" for k in range(n)), "s")])
        begin = time.perf_counter()
        assert sum(len(r.text.split()) for r in mixture.mixed_documents(docs).collect()) == round(1.5 * n / 64) * 64
        return time.perf_counter() - begin

    seconds(6400)
    assert seconds(76_800) < 2.5 * max(seconds(38_400), 1.0)


ODD_TEXTS = ["", "a", "a\0b a\0 a", "x" * 50 + " " + "x" * 16 + " " + "x" * 17, "<|endoftext|> <|startoftext|>a b<|endoftext|>c", "á ß İ 𝒳 é́ \u00a0 it's don't", None, " \t\n", "w " * 3000]


def test_word_tables_give_the_ids_of_the_library(monkeypatch):
    from tokenizers import Tokenizer

    from sessionloom.llm import word_table

    library = Tokenizer.from_file(PATH)
    draw = np.random.default_rng(8)
    letters = np.array(list("abcdefghijklmnop.,'é"))
    texts = ODD_TEXTS + [" ".join("".join(draw.choice(letters, int(draw.integers(1, 22)))) for _ in range(int(draw.integers(0, 60)))) for _ in range(300)]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    data = [None if t is None else t.encode() for t in texts]
    for words, recent, slice_ in ((1_500_000, 1 << 16, 1 << 20), (500, 50, 1 << 9), (20, 5, 64)):
        monkeypatch.setattr(word_table, "CACHED_WORDS", words)
        monkeypatch.setattr(word_table, "RECENT", recent)
        monkeypatch.setattr(word_table, "SLICE", slice_)
        table = word_table.WordTable(PATH)
        for _ in range(2):
            assert [i.tolist() for i in table.ids(data)] == want
    # Words with equal hashes are told apart.
    monkeypatch.setattr(word_table, "mix", lambda x: x & np.uint64(3))
    assert [i.tolist() for i in word_table.WordTable(PATH).ids(data)] == want


@pytest.mark.parametrize("kinds", [1, 2, 5, 300])
def test_grammars_expand_to_their_ids(kinds):
    draw = np.random.default_rng(kinds)
    for n in (0, 1, 2, 3, 50, 5000):
        ids = draw.integers(0, kinds, n).astype("<u4")
        g = repair_codec.compressed(ids)
        assert (g.expanded(g.symbols) == ids).all() and (g.whole() == ids).all() and len(g.symbols) <= n
        for _ in range(8):
            a, b = sorted(draw.integers(0, n + 1, 2).tolist())
            assert (g.between(a, b) == ids[a:b]).all()
        assert (repair_codec.widened(repair_codec.narrow(g.symbols)) == g.symbols).all()


def test_repeats_are_replaced():
    ids = np.tile(np.arange(40), 100).astype("<u4")
    g = repair_codec.compressed(ids)
    assert len(g.symbols) + 2 * len(g.rules) < len(ids) / 4 and g.spans.max() > 2
    # Few rules for many ids: each is expanded once.
    prose = np.random.default_rng(1).choice(np.array([3, 5, 8, 9]), 20_000, p=[0.7, 0.1, 0.1, 0.1]).astype("<u4")
    g = repair_codec.compressed(prose)
    assert g.base + g.spans.sum() < len(prose) and (g.whole() == prose).all() and g.whole().dtype == prose.dtype


def test_files_give_the_ids_back(spark, documents, odd, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    for k, table in enumerate((odd, documents([(i, f"Doc {i} says <|endoftext|> hello " * (i % 5)) for i in range(200, 0, -1)]))):
        rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in table.collect()))
        want, at = [], 0
        for some, i, text in rows:
            ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
            want.append((i if some else None, len(ids), zlib.crc32(ids.tobytes())))
        repair_codec.encode(table, PATH, f"{tmp_path}/{k}", shard_ids=500)
        got = sorted(repair_codec.decode(spark, f"{tmp_path}/{k}").collect(), key=lambda r: r.start)
        for r in got:
            assert r.start == at
            at += len(r.ids) // 4
        # Rows of one id are ordered among themselves by text.
        assert Counter((r.doc_id, len(r.ids) // 4, zlib.crc32(r.ids)) for r in got) == Counter(want)
        assert [r.doc_id for r in got] == [w[0] for w in want]
    assert repair_codec.encoded_digests(odd.limit(0), PATH).count() == 0


def test_pipeline_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    kept = corpus_pipeline.quality(spark, docs, sf)
    assert kept.columns == docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    stay = {r.doc_id for r in kept.select("doc_id").collect()}
    long = {r.doc_id for r in docs.collect() if len((r.text or "").split()) >= 50}
    assert all((i in stay) == (quality == 1) for i, quality in labels.items() if i in long)


def test_pipeline_equals_its_stages_by_hand(spark, sf):
    """Near copies, items, mix and codes by plain Python from what the quality stage keeps."""
    from tests.llm.test_pairs import brute_components

    kept = corpus_pipeline.quality(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()
    roots = brute_components([(r.doc_id, r.text) for r in kept], 5, 80)
    items = [r.text.lower() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    single = {r.doc_id: r for r in kept if roots[r.doc_id][1] == r.doc_id}
    clean = {i for i, r in single.items() if not any(t in r.text.lower() for t in items)}
    docs = spark.createDataFrame([single[i] for i in sorted(clean)], spark.read.parquet(f"{sf}/documents.parquet").schema)
    want = sorted(map(tuple, corpus_pipeline.token_ids(spark, corpus_pipeline.mixing(spark, docs, sf), sf).collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == want


def test_pipeline_stages_take_odd_rows(spark, odd, sf):
    """Every stage takes nulls, empty and long texts, repeated rows, clashing columns and an empty table."""
    stages = dict(corpus_pipeline.STAGES)
    for docs in (odd, odd.limit(0)):
        for name, stage in list(stages.items())[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns, name
            rows = out.collect()
            assert len(rows) <= 2 * docs.count() and (docs is odd or not rows)
        assert stages["token_ids"](spark, docs, sf).count() == docs.count()
    # What the filters see alone: clean, unrepeated rows stay.
    assert stages["decontamination"](spark, odd, sf).count() == odd.count()
    same = stages["near_duplicates"](spark, odd, sf).collect()
    assert sum(r.doc_id == 6 for r in same) == 1 and {r.doc_id for r in same} >= {1, 2, 3, 4, 5}
