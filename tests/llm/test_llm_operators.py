"""The training-data operators against brute force on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tabulark.llm import (
    chat_format,
    embedding_dedup,
    line_dedup,
    packing,
    quality_rules,
    sentencepiece_codec,
    sharding,
    simhash_dedup,
    substring_dedup,
    toxicity,
)
from tabulark.llm.common import settled
from tabulark.llm.components import components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, component_id int, text_key string, h1 string, drops int"
WORDS = [f"w{i}" for i in range(400)]


def table(spark, texts):
    rows = [(i, t, "en", "s", None if t is None else len(t), 7, "k", "h", 1) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    passage = " ".join(rng.choice(WORDS, 60))
    made = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (None, "a b c"), (3, "other text of one id"), (4, "ok\n" * 400)]
    for i in range(10, 40):
        body = "\n".join(" ".join(rng.choice(WORDS, rng.integers(3, 60))) for _ in range(4))
        made.append((i, body + ("\n" + passage + "\nend " + str(i) if i % 3 == 0 else "")))
    made += [(50, made[-1][1]), (51, made[-1][1] + " tail"), (12, made[9][1]), (12, made[9][1])]
    made.append((60, "x " * 3000 + " ".join(rng.choice(WORDS, 5000))))
    return made


@pytest.fixture(scope="module")
def docs(spark, texts):
    settled(spark)
    return table(spark, texts).cache()


def connected(n, pairs):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(21)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_simhash_groups(spark, docs, texts):
    prints = []
    for _, text in texts:
        words = (text or "").encode().lower().split()
        if not words:
            prints.append(0)
            continue
        shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
        ones = sum((np.array([xxhash.xxh64_intdigest(s, 42) >> b & 1 for b in range(64)]) for s in shingles))
        prints.append(sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles)))
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root = connected(len(prints), pairs)
    smallest = {}
    for (doc_id, _), r in zip(texts, root):
        if doc_id is not None:
            smallest[r] = min(smallest.get(r, doc_id), doc_id)
    expected = Counter((i, f, smallest.get(r)) for (i, _), f, r in zip(texts, prints, root))
    rows = simhash_dedup.groups(docs).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in rows) == expected
    stays = simhash_dedup.one_of_each(docs)
    assert stays.columns == docs.columns and stays.count() == len(set(root))
    assert simhash_dedup.groups(docs.limit(0)).count() == 0 == simhash_dedup.one_of_each(docs.limit(0)).count()


def test_simhash_index_with_crowded_leads(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base.tolist():
        for _ in range(30):
            fps.add(b ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(1, 7), replace=False)))
    low = [int(x) for x in rng.integers(0, 1 << 20, 3000)]  # all share their upper bits
    fps = sorted({f & ((1 << 63) - 1) for f in fps} | set(low))
    monkeypatch.setattr(simhash_dedup, "LEAF", 64)
    monkeypatch.setattr(simhash_dedup, "FAN", 4)
    x = np.array(fps, np.uint64)
    pairs = [(i, int(j)) for i in range(len(x)) for j in np.nonzero(np.bitwise_count(x[i] ^ x[:i]) <= 4)[0]]
    root = connected(len(x), pairs)
    edges = simhash_dedup.links(spark.createDataFrame([(f,) for f in fps], "fp bigint"), 4)
    found = {r.node: r.component for r in components(edges).collect()}
    assert [found.get(f, f) for f in fps] == [fps[r] for r in root]


def test_gray_rank_orders_the_gray_sequence(spark):
    codes = [n ^ n >> 1 for n in range(64)]
    rows = spark.createDataFrame([(c,) for c in codes], "c bigint").select("c", simhash_dedup.gray_rank(F.col("c")).alias("r")).collect()
    assert [r.r for r in rows] == list(range(64))


def test_line_groups(spark, texts):
    made = [(1, "The quick brown fox jumps\n\n!!\nTHE QUICK, BROWN fox jumps"), (2, "the quick brown fox jumps\nnew line here"), (3, None), (4, "")]
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(8)]
    long = " ".join(words)
    made += [(5, long), (6, long.replace("wordcc", "other")), (None, "new line here"), (7, "the the quick brown fox jumps"), (7, "the the quick brown fox jumps")]
    kept = line_dedup.without_repeated_lines(table(spark, made)).collect()
    by = defaultdict(list)
    for r in kept:
        by[r.doc_id].append((r.lines.n_lines, r.lines.n_removed, r.lines.kept))
    assert by[1] == [(4, 1, "The quick brown fox jumps\n\n!!")]
    assert by[2] == [(2, 1, "new line here")]
    assert by[3] == [(0, 0, None)] and by[4] == [(1, 0, "")]
    assert by[5] == [(1, 0, long)] and by[6] == [(1, 1, "")]
    assert by[None] == [(1, 1, "")]
    assert len(by[7]) == 2 and len(set(by[7])) == 1
    assert kept[0].component_id == 7 and kept[0].drops == 1
    assert line_dedup.without_repeated_lines(table(spark, [])).count() == 0


def word_changes(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row = row, [i]
        for j, b in enumerate(y, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (a != b)))
    return row[-1]


def test_similar_lines_are_found_at_every_length(spark):
    settled(spark)
    rng = np.random.default_rng(8)
    lines = []
    for n in [*range(4, 13), *range(14, 51, 4)] * 4:
        base = list(rng.choice(WORDS, n))
        lines.append(base)
        for most in (n // 5, n // 5, n // 5 + 1, 1):
            other = list(base)
            for place in rng.choice(n, most, replace=False) if rng.random() < 0.5 else range(most and 4, n, 5):
                other[place] = str(rng.choice(WORDS))
            if rng.random() < 0.3:
                del other[int(rng.integers(len(other)))]
            lines.append(other)
    lines.append(["x"] * 20)
    lines.append(["x"] * 17 + ["y"])
    order = sorted({" ".join(x): x for x in lines}.items(), key=lambda item: len(item[1]))
    pairs = []
    for i, (_, x) in enumerate(order):
        for j, (_, y) in enumerate(order[:i]):
            most = len(x) // 5
            if len(x) - len(y) <= most and len(set(x) & set(y)) * 2 >= len(set(y)) and word_changes(x, y) <= most:
                pairs.append((i, j))
    root = connected(len(order), pairs)
    rows = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(order)], "doc_id bigint, text string")
    kept = {r.doc_id for r in line_dedup.without_repeated_lines(rows).collect() if not r.lines.n_removed}
    assert len(pairs) > 150 and kept == {i for i, r in enumerate(root) if i == r}


def test_repeated_passages(spark, docs, texts):
    width = 35
    words = [(t or "").encode().split() for _, t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    expected = Counter()
    for (doc_id, _), w in zip(texts, words):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        expected[doc_id, len(w), sum(gone), kept] += 1
    rows = substring_dedup.without_repeats(docs, width).collect()
    assert Counter((r.doc_id, r.dedup.n_words, r.dedup.n_removed, bytes(r.dedup.kept)) for r in rows) == expected
    assert sum(r.dedup.n_removed for r in rows) > 1000
    assert substring_dedup.without_repeats(docs.limit(0), width).count() == 0


def test_long_windows_are_marked_in_parts(spark):
    rng = np.random.default_rng(1)
    shared = " ".join(rng.choice(WORDS, 300))
    rows = substring_dedup.without_repeats(table(spark, [(1, "a " + shared), (2, shared + " b"), (3, "c " + shared[:500])]), 120).collect()
    assert {r.doc_id: r.dedup.n_removed for r in rows}[1] == 300 == {r.doc_id: r.dedup.n_removed for r in rows}[2]


def vocabulary():
    import public_tokenizers as public

    return {"ranks": public.path("byte_bpe_50k.tiktoken"), "pattern": public.PATTERN}


def test_packing_round_trip(spark, docs, texts):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    ids = Counter()
    for doc_id, text in texts:
        ids[doc_id, np.array([*reference.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()] += 1
    rows = packing.pack(docs, **vocabulary()).collect()
    sequences = defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
        total = sum(n for _, n in pieces)
        assert total <= 1024 and total & (total - 1) == 0
    assert sum(r.length for r in rows) == sum(len(k[1]) // 4 * n for k, n in ids.items())
    whole = defaultdict(dict)
    for r in rows:
        whole[r.doc_id, r.doc_tokens][r.start] = bytes(r.ids)
    for doc_id, data in ids:
        assert b"".join(part for _, part in sorted(whole[doc_id, len(data) // 4].items())) == data
    assert packing.pack(docs.limit(0), **vocabulary()).count() == 0


@pytest.mark.parametrize("text", ["", " ", "  a", "a  b", "a\n b", "a \nb", "a\n \nb", " a\t\tb  ", "it's  1234 néé  x　y 😀😀", "\r\n x", "don't " * 3])
def test_words_cut_where_no_token_crosses(text):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    bpe = packing.ByteBpe(**vocabulary())
    reference = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    assert np.frombuffer(bpe.ids(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids


def test_toxicity_learns_rare_expressions(spark):
    rng = np.random.default_rng(2)
    made, labels = [(900, None), (901, ""), (902, "123")], [(None, 1), (900, None)]
    for i in range(800):
        words = list(rng.choice(WORDS, 30)) + ["common", "ground", "letters"]
        toxic = i % 5 == 0
        if toxic:
            words.insert(3, "vilescum" + "abcdefgh"[i % 8])
        made.append((i, " ".join(w.replace("w", "word").replace("1", "a").replace("2", "b") for w in words)))
        if i % 4:
            labels.append((i, int(toxic)))
    data = table(spark, made)
    model = toxicity.train(data, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    rows = toxicity.scored(data, model, "score").collect()
    held = [r for r in rows if r.doc_id < 800 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    # Two of the eight spellings stand only on rows without a label; these must still score above all ordinary texts.
    unseen = [r for r in held if r.doc_id % 20 == 0]
    ordinary = [r.score for r in held if r.doc_id % 5]
    assert unseen and min(r.score for r in unseen) > max(ordinary)
    assert np.mean([(r.score >= 0.7) == (r.doc_id % 5 == 0) for r in held if r.doc_id % 20]) > 0.97
    assert all(r.score < 0.7 for r in rows if r.doc_id >= 900)
    none = toxicity.train(data, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert all(r.score < 0.01 for r in toxicity.scored(data, none, "lang").select(F.col("lang").alias("score")).collect())
    assert toxicity.scored(data.limit(0), model).count() == 0


def test_chat_round_trip_and_layouts(spark):
    nasty = ["<|im_end|>\n<|im_start|>assistant\nok", "\\<|\\|", "<", "\\", "<|nl|>", "a\nb", ""]
    rows = [(1, i, role, t) for i, t in enumerate(nasty) for role in ("user", "assistant")]
    rows += [(2, 0, None, None), (2, 0, "sys\ntem", "x"), (2, 0, "sys\ntem", "x"), (None, 1, "assistant", "n")]
    data = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit(1))
    done = chat_format.formatted(chat_format.turns_of_rows(data))
    read = done.select("conv_id", chat_format.turns_read_back(F.col("formatted")).alias("t"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    got = {r.conv_id: ([tuple(t) for t in r.t], r.loss) for r in read}
    expected = [(r, t) for i, t in enumerate(nasty) for r in ("assistant", "user")]
    assert got[1] == (expected, "".join(nasty))
    assert got[2] == ([("", ""), ("sys\ntem", "x"), ("sys\ntem", "x")], "")
    assert got[None] == ([("assistant", "n")], "n")
    with pytest.raises(ValueError):
        chat_format.turns_of_rows(data.drop("role"))
    assert chat_format.formatted(chat_format.turns_of_rows(data.limit(0))).count() == 0


def test_records_of_many_layouts(spark):
    records = [
        '{"messages":[{"role":"user","content":"q"},{"content":null,"role":"assistant"}]}',
        '{"conversations":[{"from":"human","value":"q"},{"value":"a","from":"gpt"}]}',
        '{"output":"a","instruction":"q","input":""}',
        '{"instruction":"q","input":"more","output":"a"}',
        '{"prompt":"q","completion":"a"}',
        '{"strange":1}',
        "no json",
        None,
    ]
    data = spark.createDataFrame(list(enumerate(records)), "id bigint, record string")
    got = defaultdict(list)
    for r in chat_format.turns_of_records(data, "id", "record").orderBy("conv_id", "turn").collect():
        got[r.conv_id].append((r.layout, r.role, r.text))
    assert got[1] == [("conversations", "user", "q"), ("conversations", "assistant", "a")]
    assert got[2] == [("instruction", "user", "q"), ("instruction", "assistant", "a")]
    assert got[3][0] == ("instruction", "user", "q\n\nmore")
    assert got[4] == [("completion", "user", "q"), ("completion", "assistant", "a")]
    assert got[0] == [("messages", "user", "q"), ("messages", "assistant", "")]
    assert got[5] == got[6] == got[7] == [(None, None, None)]


def model_file():
    import public_tokenizers as public

    return public.path("piece_bpe_32k.model")


def best_path(text, v):
    best = [(0.0, [])]
    for end in range(1, len(text) + 1):
        options = []
        for start in range(max(0, end - v.longest), end):
            hit = v.pieces.get(text[start:end])
            if hit:
                options.append((best[start][0] + hit[1], start, [hit[0]]))
            elif end == start + 1:
                options.append((best[start][0] + v.unknown, start, [v.bytes_ids[b] for b in text[start].encode()]))
        score, start, ids = max(options, key=lambda o: (o[0], -o[1]))
        best.append((score, best[start][1] + ids))
    return best[-1][1]


def test_streaming_viterbi_finds_the_best_path():
    v = sentencepiece_codec.Vocabulary(model_file())
    rng = np.random.default_rng(4)
    for text in ("▁hello▁world", "▁▁▁a▁▁b", "ünïcödé😀x\n", "aaaa" * 60, "".join(rng.choice(list("etaoin shrdlu▁"), 3000))):
        ids = [i for part in sentencepiece_codec.viterbi(text, v) for i in part]
        assert ids == best_path(text, v)
        assert sentencepiece_codec.Encoder(model_file())._encode(text) == np.array(ids, "<u4").tobytes()


def test_pieces_round_trip(spark, docs, texts):
    odd = table(spark, [*texts, (70, "  two  spaces\n\n \t"), (71, "▁x"), (72, "x" * 5000)])
    coded = odd.withColumn("ids", sentencepiece_codec.encoded(model_file())("text"))
    rows = coded.withColumn("back", sentencepiece_codec.decoded(model_file())("ids")).collect()
    for r in rows:
        assert r.back == (None if r.text is None else r.text.replace("▁", " "))
    v = sentencepiece_codec.Vocabulary(model_file())
    for r in rows[:20]:
        if r.text:
            assert np.frombuffer(r.ids, "<u4").tolist() == best_path("▁" + r.text.replace(" ", "▁"), v)


def test_quality_numbers_and_risk(spark, docs, texts):
    rows = quality_rules.measured(docs).collect()
    found = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    expected = Counter()
    for doc_id, text in texts:
        text = text or ""
        words = text.encode().split()
        n = len(words)
        seen = Counter(tuple(words[i : i + 8]) for i in range(n - 7))
        marked = [any(seen[tuple(words[j : j + 8])] > 1 for j in range(max(0, i - 7), min(i, n - 8) + 1)) for i in range(n)]
        lines = [line for line in text.split("\n") if line.encode().split()]
        chars = sum(len(w.decode()) for w in words)
        expected[doc_id, n, chars, sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), sum(marked)] += 1
    assert found == expected


def test_cutoffs_keep_the_promised_share(spark):
    from math import comb

    pairs = [(50, 0), (50, 1), (400, 1), (5000, 10), (5000, 40), (100, 100), (3, 0)]
    rows = spark.createDataFrame(pairs, "n bigint, r bigint")
    got = {(x.n, x.r): x.p for x in rows.select("n", "r", quality_rules.binomial_tail(F.col("n"), F.col("r"), 0.01).alias("p")).collect()}
    for n, r in pairs:
        exact = sum(comb(n, k) * 0.01**k * 0.99 ** (n - k) for k in range(r + 1))
        assert got[n, r] == (1.0 if r >= n * 0.01 else pytest.approx(exact, rel=1e-9))
    good = [(i, " ".join(WORDS[i % 300 : i % 300 + 30]) + (" # # #" if i % 50 == 0 else ""), "en", "s", 0, 1, "", "", 0) for i in range(3000)]
    bad = [(i, " ".join(WORDS[:25]) + " $ $ $ $ $ $ $ $", None, "s", 0, 1, "", "", 0) for i in range(3000, 3100)]
    bad += [(i, " ".join(WORDS[:25]) + " $ $ $ $ $ $ $ $", "en", "s", 0, 1, "", "", 0) for i in range(3100, 3200)]
    labels = spark.createDataFrame([(i, int(i < 3000)) for i in range(3200)] + [(None, 1), (5, None)], "doc_id bigint, quality int")
    judged = quality_rules.judged(spark.createDataFrame(good + bad, SCHEMA), labels).select("doc_id", "kept").collect()
    kept = {r.doc_id for r in judged if r.kept}
    assert len(judged) == 3200 and len([i for i in kept if i < 3000]) >= 2940
    assert not any(3100 <= i < 3200 for i in kept) and all(i in kept for i in range(3000, 3100))
    empty = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality_rules.judged(spark.createDataFrame(good[:50], SCHEMA), empty).where("kept").count() == 50


def test_embedding_links(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 50)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 24)) * np.linspace(3, 0.1, 24)
    vectors = [(base[i % 40] + rng.normal(size=24) * 0.08 * (i % 5)).astype(np.float32).tolist() for i in range(400)]
    rows = [(i, i % 3, v) for i, v in enumerate(vectors)] + [(500 + i, 0, vectors[0]) for i in range(30)]
    odd = [(600, 1, None), (601, 1, [0.0] * 24), (602, 1, [float("nan")] * 24), (603, None, vectors[3]), (604, 1, [None] * 24), (605, 1, []), (None, 0, [1e30] * 24), (606, 2, [1.0, 2.0])]
    data = spark.createDataFrame(rows + odd, "vec_id bigint, label int, embedding array<float>").withColumn("kept", F.lit("x"))
    x = np.array([r[2] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[1] for r in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    root = connected(len(rows), list(zip(*np.nonzero(np.tril(near, -1)))))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.linked(data).collect()}
    for i, row in enumerate(rows):
        assert got[row[0]] == (int(near[i].sum()) - 1, rows[root[i]][0], root[i] == i)
    assert all(got[i] == (0, i, True) for i in range(600, 607))
    assert got[None] == (0, None, False)
    assert embedding_dedup.linked(data.limit(0)).count() == 0


def test_slots_are_gapless_and_maps_are_edited(spark, docs, texts):
    rows = sharding.records(docs, 64)
    sizes = sharding.slot_sizes(rows, 64)
    first = sharding.first_map(sizes, 4)
    path = sharding.stored_map(spark, first, sizes, 1)
    placed = sharding.placed(rows, sharding.current_map(spark, path)).collect()
    assert len(placed) == len(texts) and sum(r.size for r in placed) == sum(len((t or "").encode()) + 8 for _, t in texts)
    by = defaultdict(list)
    for r in placed:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    grown = sharding.rebalanced(first, sizes, 5)
    assert {grown[s] for s in grown if grown[s] != first[s]} <= {4} | set(range(4)) and 4 in grown.values()
    fewer = sharding.rebalanced(first, sizes, 3)
    assert set(fewer.values()) <= {0, 1, 2} and set(fewer) == set(first)
    sharding.stored_map(spark, grown, sizes, 2, path)
    assert sharding.current_map(spark, path).first().version == 2
    assert sharding.current_map(spark, path, 1).count() == 64
    empty = sharding.records(docs.limit(0), 64)
    assert sharding.placed(empty, sharding.current_map(spark, path)).count() == 0


def test_pipeline_stages_keep_the_columns(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(9)
    rows = []
    for i in range(120):
        body = "\n".join(" ".join(rng.choice(WORDS, 20)) for _ in range(4))
        rows.append((i, body + (" horridword" if i % 6 == 0 else ""), "en", "s", None))
    rows += [(200, rows[5][1], "en", "s", 0), (201, None, None, None, None), (202, "", "en", "s", 0)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(i % 6 == 0)) for i in range(120)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.count()
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    # The copy loses its lines and then meets the empty texts, of which one stays.
    assert seen["toxicity"] == seen["line dedup"] == len(rows) - 20
    assert seen["simhash near-dedup"] == seen["substring dedup"] == len(rows) - 22
    assert hashlib.sha256(str(sorted(docs.columns)).encode()) and docs.where("doc_id % 6 = 0 and doc_id < 120").count() == 0
