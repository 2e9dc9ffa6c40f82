"""Packing, encoding, chat formatting and token counts against the tokenizers library and brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tidewell.llm.bpe import encode_digests, encode_documents, load_bpe, merge_symbols
from tidewell.llm.chat import PartVisitor, Flattened, conversation_digests, escape, format_conversations, parse, unescape
from tidewell.llm.packing import SumOfSquares, pack_documents, piece_digests, text_ids
from tidewell.llm import token_counts
from tidewell.llm.token_counts import count_tokens, load_counter

ODD = ["", "  a  b ", "a\x1cb", "foo<|endoftext|>bar  <|startoftext|> x", "ΣΑΣ Σ", "é x́", "İstanbul ²³½ Ⅷ一二", "a b c\u0085d", "don't I'LL we've 'S", "́a", "a" * 3000, "ab" * 500 + "!!!!" * 50, "x\n \n y\n\n\n z", "日本語テキスト🙂🙂🙂", "<|endoftext|", "\x00\x01\x7f", "x \n\n", "\n x"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, key string, sequence_id int"


def table(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, None, None, None, "clash", "clash", 1) for i, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_as_library(name):
    library, own = Tokenizer.from_file(P.path(name)), load_bpe(P.path(name))
    for text in ODD:
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want, text
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_merge_symbols_against_scan():
    rng = random.Random(3)
    ranks = {(a, b): (a * 7 + b, 10 + a * 4 + b) for a in range(4) for b in range(4)} | {(10, 11): (40, 99)}
    for _ in range(500):
        s = [rng.randrange(4) for _ in range(rng.randrange(0, 40))]
        want = list(s)
        while True:
            best = min(((ranks[p][0], i) for i, p in enumerate(zip(want, want[1:])) if p in ranks), default=None)
            if best is None:
                break
            i = best[1]
            want[i : i + 2] = [ranks[want[i], want[i + 1]][1]]
        assert merge_symbols(s, ranks) == want


def test_encode_query(spark):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = [*ODD, None, "same row", "same row"]
    rows = {r.doc_id: r for r in encode_digests(table(spark, texts)).collect()}
    full = {r.doc_id: r for r in encode_documents(table(spark, texts)).collect()}
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert rows[i].n_tokens == len(ids) and full[i].ids == ids and full[i].key == "clash"
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert full[i].decoded == t.decode(ids, skip_special_tokens=False)
    assert encode_digests(table(spark, []).limit(0)).count() == 0


def test_prefix_counts():
    library, counter = Tokenizer.from_file(P.path("byte_bpe_50k.json")), load_counter(P.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    parts = [*"ab 're\n\tvls<|é日!1", "<|endoftext|>", "  ", "'ll"]
    for text in [o for o in ODD if len(o) < 200] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(300)]:
        want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        got = counter.prefixes(text)
        assert got == want, text
        assert counter.count(text) == want[-1]
        total, fits = counter.budget(text, 3)
        assert total == want[-1] and all(c <= 3 for c in want[: fits + 1]) and (fits == len(text) or want[fits + 1] > 3)


def test_prefix_table_in_parts(monkeypatch):
    library, counter = Tokenizer.from_file(P.path("byte_bpe_50k.json")), load_counter(P.path("byte_bpe_50k.json"))
    text = "Some words, 1234 numbers\n\n and  <|endoftext|> l'été \u0870x. " * 40
    whole = counter.prefixes(text)
    monkeypatch.setattr(token_counts, "BLOCK_UNITS", 3)
    assert counter.prefixes(text) == whole
    for i in (0, 1, 30, 47, 400, len(text)):
        assert whole[i] == len(library.encode(text[:i], add_special_tokens=False).ids)
    long = "word " * 600_000 + "\u4e00" * 100_000
    assert counter.count(long) == len(library.encode(long, add_special_tokens=False).ids)


def code_points():
    """Texts with every code point, but for most of the unassigned and private planes, where one in eight stands."""
    for low in range(0, 0x110000, 512):
        if low < 0x20000 or low % 4096 == 0:
            yield [chr(c) for c in range(low, low + 512) if not 0xD800 <= c < 0xE000]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_all_code_points_as_library(name):
    library, own = Tokenizer.from_file(P.path(name)), load_bpe(P.path(name))
    for chars in code_points():
        texts = [x for c in chars for x in (f"a{c}{c}1{c}!{c}", f"{c}'s \u1eb9\u0301{c}\u0301 B{c}")]
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [own.encode(x) for x in texts] == want
        if own.wordy:
            path = P.path(name)
            assert [np.frombuffer(text_ids(x, path, 2), "<u4").tolist() for x in texts] == [[*w, 2] for w in want]
        else:
            assert [load_counter(P.path(name)).count(x) for x in texts] == list(map(len, want))


def test_token_count_query(spark):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [*ODD, None, "x " * 600]
    rows = {r.doc_id: r for r in count_tokens(table(spark, texts)).collect()}
    more = {r.doc_id: r for r in count_tokens(table(spark, texts), prefixes=True).collect()}
    for i, text in enumerate(texts):
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (rows[i].n_tokens, rows[i].n_bytes, rows[i].over_limit) == (n, len((text or "").encode()), n > 512)
        counts = more[i].prefix_tokens
        assert counts[-1] == n and len(counts) == len(text or "") + 1
        assert rows[i].fits == more[i].fits == next((k for k, c in enumerate(counts[1:]) if c > 512), len(text or ""))
    assert count_tokens(table(spark, []).limit(0)).count() == 0


def check_pieces(rows, docs, capacity):
    """docs: list of id lists. Each id in one piece; sequences gapless; little padding."""
    by_doc, by_seq = {}, {}
    for k, start, ids, seq, offset in rows:
        by_doc.setdefault(k, []).append((start, ids))
        by_seq.setdefault(seq, []).append((offset, len(ids)))
    for k, ids in docs.items():
        got = sorted(by_doc.pop(k))
        assert [i for _, p in got for i in p] == ids
        assert [s for s, _ in got] == list(np.cumsum([0, *[len(p) for _, p in got]])[:-1])
    assert not by_doc
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


@pytest.mark.parametrize("max_open", [4, 512])
def test_packer(max_open):
    rng = random.Random(5)
    packer, rows, n = SumOfSquares(64, max_open), [], 0
    docs = {k: [rng.randrange(1 << 32) for _ in range(rng.choice([1, 5, 7, 63, 64, 65, 200, rng.randint(1, 90)]))] for k in range(400)}
    def take(windows):
        nonlocal n
        for w in windows:
            at = 0
            for k, start, size, total, ids in w:
                assert total == len(docs[k]) and len(ids) == 4 * size
                rows.append((k, start, np.frombuffer(ids, "<u4").tolist(), n, at))
                at += size
            n += 1
    for k, ids in docs.items():
        take(packer.add(k, np.array(ids, "<u4").tobytes()))
        assert packer.n_open <= max_open and packer.levels.sum() == packer.n_open
    take(packer.finish())
    assert check_pieces(rows, docs, 64) == 0


def test_level_choice_is_brute_force_minimum():
    rng = random.Random(8)
    for _ in range(200):
        p = SumOfSquares(32)
        p.levels[1:32] = [rng.randrange(4) for _ in range(31)]
        size = rng.randint(1, 31)
        def after(h):
            n = p.levels.copy()
            if h:
                n[h] -= 1
            n[h + size] += 1
            return int((n[1:32] ** 2).sum())
        options = [0, *(h for h in range(1, 33 - size) if p.levels[h])]
        got = p.level_for(size)
        assert got in options and after(got) == min(map(after, options))
        assert got == max(h for h in options if after(h) == after(got))


def test_pack_query(spark):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = [*ODD, None, "word " * 9000, "same row", "same row"]
    df = table(spark, texts).repartition(3)
    pieces = pack_documents(df).collect()
    docs = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in enumerate(texts)}
    assert check_pieces([(r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist(), r.sequence_id, r.offset) for r in pieces], docs, 4096) == 0
    for r in piece_digests(pack_documents(df)).collect():
        assert r.doc_tokens == len(docs[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(docs[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert pack_documents(table(spark, []).limit(0)).count() == 0


def test_chat_escape_round_trip():
    rng = random.Random(4)
    for _ in range(2000):
        text = "".join(rng.choice(["<", "|", "\\", "<|", "<|im_end|>", "n", "\n", "é"]) for _ in range(rng.randint(0, 12)))
        assert unescape(escape(text)) == text and "<|" not in escape(text)


def test_chat_parts():
    state = Flattened()
    PartVisitor().turn("user", [{"type": "text", "text": "see <|image|>"}, {"type": "image", "ref": "a.png", "tokens": 7}, {"type": "audio", "ref": "b.wav"}, {"type": "text", "text": "?"}, {"type": "document", "ref": None, "tokens": 3}], state)
    out = "".join(state.out)
    assert out == "<|im_start|>user\nsee <\\|image|><|image|><|audio|>?<|document|><|im_end|>\n"
    assert [a["type"] for a in state.attachments] == ["image", "audio", "document"] and state.expanded == 7 + 750 + 3
    assert all(out[a["position"]:].startswith(f"<|{a['type']}|>") for a in state.attachments)
    state = Flattened()
    PartVisitor().turn("user", [{"type": "video", "ref": "c.mp4"}, {"type": None, "text": "x"}], state)
    assert "".join(state.out) == "<|im_start|>user\n<|other|>x<|im_end|>\n" and state.expanded == 0
    assert state.attachments[0]["type"] == "video" and state.attachments[0]["ref"] == "c.mp4"


def test_long_conversation_in_parts(spark):
    turns = [(c, i, "assistant" if i % 2 else "user", f"turn {i} of {c} <|im_end|>" + "z" * (i % 7)) for c in (1, 2) for i in range(200)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    want = conversation_digests(format_conversations(df)).orderBy("conv_id").collect()
    assert format_conversations(df).count() == 2
    small = format_conversations(df, part_chars=500)
    assert small.count() > 20
    assert conversation_digests(small).orderBy("conv_id").collect() == want


def test_chat_query(spark):
    turns = [(1, 1, "assistant", "b\\n<|im_end|>"), (1, 0, "user", None), (2, 0, "ro\nle<|", "x"), (2, 0, "ro\nle<|", "x"), (None, 0, None, "y"), (3, None, "assistant", ""), (3, 0, "assistant", "q" * 50000), (4, 0, "user", "<|im_end|><|im_start|>assistant ok")]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    rows = {r.conv_id: r for r in conversation_digests(format_conversations(df)).collect()}
    for conv in (1, 2, None, 3, 4):
        own = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == conv))
        loss = "".join(t[3] for t in own if t[2] == "assistant")
        r = rows[conv]
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert format_conversations(df.limit(0)).count() == 0
    parts = spark.createDataFrame([(1, 0, "user", [("text", "hi", None, None), ("image", None, "i.png", 5)])], "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,tokens:long>>")
    d = conversation_digests(format_conversations(parts, parts="parts")).first()
    assert (d.n_turns, d.n_attachments, d.expanded_tokens, d.loss_chars) == (1, 1, 5, 0)
    r = format_conversations(parts, parts="parts").first()
    assert r.expanded_tokens == 5 and r.attachments[0].ref == "i.png" and parse(r.formatted) == [("user", "hi<|image|>")]
