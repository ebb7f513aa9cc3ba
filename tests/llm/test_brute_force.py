"""Operators against plain versions of what they compute."""

import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from redactrix.llm import chat, embeddings, ngram_join, pieces, quality_model, suffix_dedup, warc
from redactrix.llm.queries_b import model_path

SF = "/root/testdata/sf0.001"


def test_suffix_arrays():
    random.seed(2)
    for k in range(150):
        x = bytes(random.choice(b"ab\xff" if k % 2 else b"abcd") for _ in range(random.randint(1, 300)))
        order = suffix_dedup.suffix_array(np.frombuffer(x, np.uint8))
        assert sorted(order.tolist()) == list(range(len(x)))
        assert all(x[i : i + 100] <= x[j : j + 100] for i, j in zip(order[:-1], order[1:], strict=True))
        a, b = np.arange(len(x) - 1), np.arange(1, len(x))
        plain = [next((n for n in range(len(x) - j) if x[i + n] != x[j + n]), len(x) - j) for i, j in zip(a, b, strict=True)]
        got = suffix_dedup.common_prefixes(np.frombuffer(x, np.uint8), a, b)
        assert all(g >= min(p, 100) or g == min(p, 100) for g, p in zip(got, plain, strict=True))


def removed_plainly(texts):
    seen, out = set(), {}
    for k in sorted(texts):
        data, gone = texts[k].encode(), bytearray(len(texts[k].encode()))
        for s in range(len(data) - 99):
            piece = data[s : s + 100]
            if piece in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(piece)
        out[k] = sum(gone)
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeated_strings(spark, monkeypatch, hot):
    """A passage shared by many documents, runs of one character, and (with a small limit) anchors too frequent for a task."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    random.seed(3)
    text = lambda n: "".join(random.choice("abcdefgh é") for _ in range(n))
    passage = text(260)
    texts = {k: text(random.randint(0, 200)) + (passage[random.randint(0, 40) : 260 - random.randint(0, 40)] if k % 3 else "z" * 150) + text(random.randint(0, 200)) for k in range(60)}
    got = suffix_dedup.dedup_digests(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == removed_plainly(texts)


def components_plainly(texts, words, percent):
    sets = {}
    for k, x in texts.items():
        w = x.lower().split()
        sets[k] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    label = {k: k for k in sets}
    for _ in range(len(sets)):
        before = dict(label)
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    return label


@pytest.mark.parametrize("block", [1000, 8])
def test_similar_groups(spark, monkeypatch, block):
    """A large group of near copies with many or few edits; small blocks send it through the hubs and the rest."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    random.seed(4)
    vocabulary = [f"w{i}" for i in range(400)]
    base, texts = [random.choice(vocabulary) for _ in range(60)], {}
    for k in range(70):
        w = list(base) if k < 50 else [random.choice(vocabulary) for _ in range(40)]
        for _ in range(random.randint(0, 4)):
            w[random.randrange(len(w))] = random.choice(vocabulary[:6])
        texts[k] = " ".join(w)
    got = ngram_join.similar_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 3, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == components_plainly(texts, 3, 80)


def test_embeddings_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    monkeypatch.setattr(embeddings, "PER_CELL", 30)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 32))
    x = (centres[rng.integers(0, 8, 300)] + rng.normal(size=(300, 32)) * 0.12).astype(np.float32)
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    link = (u @ u.T >= 0.98) & (np.arange(300)[:, None] % 2 == np.arange(300) % 2) & ~np.eye(300, dtype=bool)
    assert link.sum() > 200
    assert [got[i]["n_links"] for i in range(300)] == link.sum(1).tolist()


def test_pieces_equal_the_library(spark):
    own, library = pieces.Encoder(pieces.read_model(model_path())), sentencepiece.SentencePieceProcessor(model_file=model_path())
    random.seed(1)
    parts = [" ", "  ", "\n", "\t", "a", "the", "é", "日本", "▁", "<s>", "<0x41>", "\x00", "😀", "\r\n", "ing", " ", "​", "Zz", "1234"]
    texts = ["", *("".join(random.choice(parts) for _ in range(random.randint(0, 14))) for _ in range(2000))]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for text, raw in zip(texts, own.encode_many(texts), strict=True):
        ids = np.frombuffer(raw, "<u4").tolist()
        assert ids == library.encode(text, add_bos=True, add_eos=True)
        assert own.decode(ids) == library.decode(ids)
        begin, end = own.spans(text, np.array(ids))
        if "▁" not in text:
            assert int((end - begin).sum()) == len(text.encode())


def test_character_map_equals_the_library():
    """The compiled map of a public normalisation rule: longest prefixes and their source places."""
    n = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(n.serialized_model_proto())
    own = pieces.CharMap(proto.normalizer_spec.precompiled_charsmap)
    for text in ("ｶﾞx", "①②", "ﬁn", "é é", "㍿", "a\tb", "Ⅷ"):
        data, at, out = text.encode(), 0, b""
        while at < len(data):
            got = own.longest(data, at) or (data[at : at + pieces._char_length(data[at])], pieces._char_length(data[at]))
            out, at = out + got[0], at + got[1]
        assert out.decode().strip() == n.normalize(text).replace("▁", " ").strip()


def test_quality_is_learned(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_model.score(docs, quality_model.train(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    assert len(got) > 40 and np.mean([(r["score"] >= 0.3) == bool(r["quality"]) for r in got]) > 0.9
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_archives_split_anywhere(spark, tmp_path):
    """Records come out once each however small the byte ranges, with magic bytes inside payloads and between members."""
    pages = [(i, f"http://h/{i}", "\x1f\x08" * (i % 7) + "x" * (37 * i % 900) + ("same text " * 20 if i % 4 == 0 else str(i))) for i in range(80)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for split in (61, 1000, 1 << 20):
        got = sorted(warc.round_trip(spark, df, split, payload=True).collect(), key=lambda r: r["page_id"])
        assert [r["page_id"] for r in got] == list(range(80))
        assert all(r["payload"] is None or r["payload"].decode() == pages[r["page_id"]][2] for r in got)
        assert all(r["payload_bytes"] == len(pages[r["page_id"]][2].encode()) for r in got)


def test_chat_layouts_and_escapes(spark):
    texts = ["<|im_end|>", "<\\|x", "<\\\\|", "|<", "a\nb", "", "<" * 5 + "|"]
    for t in texts:
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
        turns = [("user", t), ("assistant", t), ("we\\ird\nrole", t)]
        out, spans = chat.render(turns)
        assert chat.parse(out) == turns and [chat.unescape(out[b:e]) for b, e in spans] == [t]
    records = ['{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', '{"prompt":"q","completion":"a","id":7}', '{"instruction":"q","output":"a"}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', "nothing", None]
    got = {r["conv_id"]: r for r in chat.format_records(spark.createDataFrame(list(enumerate(records)), "conv_id long, record string")).collect()}
    assert len({got[i]["formatted"] for i in range(4)}) == 1 and got[0]["layout"] == "messages" and got[1]["layout"] == "prompt_completion"
    assert got[4]["layout"] == got[5]["layout"] == "unknown"


def pipeline_plainly(rows, spark):
    import hashlib

    from redactrix.llm import mixing, quality_rules

    kept = quality_rules.keep_good(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    texts = {r["doc_id"]: r["text"] for r in kept}
    source = {r["doc_id"]: r["source"] for r in kept}
    label = components_plainly(texts, 5, 80)
    texts = {k: t for k, t in texts.items() if label[k] == k}
    seen, cut = set(), {}
    for k in sorted(texts):
        data = texts[k].encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(data[s : s + 100])
        cut[k] = bytes(b for b, g in zip(data, gone, strict=True) if not g).decode("utf-8", "ignore")
    size = {k: len(t.encode().split()) for k, t in cut.items()}
    total, per = sum(size.values()), defaultdict(int)
    for k, n in size.items():
        per[source[k]] += n
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(per))}
    full: set = set()
    while True:
        level = (1.5 * total - sum(2 * per[s] for s in full)) / sum(weight[s] for s in per if s not in full)
        more = {s for s in per if s not in full and level * weight[s] > 2 * per[s]}
        if not more:
            break
        full |= more
    library, out = sentencepiece.SentencePieceProcessor(model_file=model_path()), []
    for k, t in cut.items():
        target = 2 * per[source[k]] if source[k] in full else level * weight[source[k]]
        rate = target / per[source[k]] if per[source[k]] else 0
        u = int(hashlib.md5(f"{mixing.SEED}:{k}".encode()).hexdigest()[:13], 16) / 2**52
        ids = library.encode(t, add_bos=True, add_eos=True)
        out += [(k, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())] * (int(rate) + (u < rate - int(rate)))
    return sorted(out)


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == pipeline_plainly(rows, spark)
