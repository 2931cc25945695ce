import numpy as np

from tabulark.llm import queries, sentencepiece_codec


def test_ids_are_those_of_the_model(spark):
    import sentencepiece

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    words = {w for r in rows for w in (r.text or "").split()} | {"und", "a" * 300, "x\U0001f600y", "ab" * 50}
    model = sentencepiece.SentencePieceProcessor(model_file=queries.pieces_model())
    merges = sentencepiece_codec.Merges(queries.pieces_model())
    differ = [w for w in words if np.frombuffer(merges.ids(w), "<u4").tolist() != model.encode(w)]
    # Words that the model's normaliser changes are not compared.
    assert not [w for w in differ if model.normalize(w) == "\u2581" + w]


def test_the_query_gives_these_ids(spark):
    import zlib

    merges = sentencepiece_codec.Merges(queries.pieces_model())
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = queries.QUERIES["op3_streaming_sentencepiece"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.round_trip and r.ids_crc32 == zlib.crc32(merges.ids(texts[r.doc_id])) for r in rows)


def test_short_stretches_are_scanned_and_shared_parts_merged_once(monkeypatch):
    merges = sentencepiece_codec.Merges(queries.pieces_model())
    made, heaped, old, heap = [], [], merges._merged, merges._heaped
    merges._merged = lambda text, *pairs: made.append(text) or old(text, *pairs)
    merges._heaped = lambda text: heaped.append(text) or heap(text)
    ends = ["", ".", ",", "!", ":", ";"]
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abdeginorstu"), rng.integers(1, 30))) for _ in range(300)]
    texts = [" ".join(w + end for w in words) for end in ends]
    scanned = [merges.ids(text) for text in texts]
    assert not heaped and len(made) <= len(set(made)) + len(words)
    monkeypatch.setattr(sentencepiece_codec, "SCANNED", 0)
    merges.known.clear()
    assert [merges.ids(text) for text in texts] == scanned and heaped
