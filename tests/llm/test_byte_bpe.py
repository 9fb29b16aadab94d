import hashlib
import random

import public_tokenizers
import tiktoken

from patronage.llm import byte_bpe, registry
from patronage.llm.byte_bpe import VOCABULARY, Decoder, Encoder, Transducer, decoded_text, digests, pieces, read_ranks, token_ids
from patronage.llm.common import table

from .conftest import by_id

PATH = public_tokenizers.path(VOCABULARY)
RANKS = read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
RANDOM = random.Random(1)
TEXTS = ["", " ", "a", "Don't you'll  see\n\n \tit", "aaaa" * 3000, "x" * 4000, "😀é漢字" * 200, "<|endoftext|>", "The " * 5000]
TEXTS += ["".join(RANDOM.choice("ab é\n😀1, thenig") for _ in range(400)) for _ in range(60)]


def test_equals_the_library():
    encoder = Encoder(PATH, public_tokenizers.PATTERN)
    for text in TEXTS:
        assert [i for part in encoder.encode(text) for i in part] == LIBRARY.encode_ordinary(text)


def test_memory_is_bounded_also_within_a_match():
    small = 80_000
    transducer = Transducer(RANKS, small)
    long = "".join(RANDOM.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000))
    for word in ("internationalisation", "thndreouble", "ééé漢字", long):
        assert transducer.encode(word.encode()) == LIBRARY.encode_ordinary(word)
        assert transducer.size < small and len(transducer.follows) < 200
    words = byte_bpe.Words(Transducer(RANKS), 30_000)
    for i in range(200):
        word = f"wd{i}x"
        assert [int(x) for x in words[word].split(" ")] == transducer.encode(word.encode())
        assert words.size < 12_000


def test_utf8_machine_equals_decoding_at_once():
    for _ in range(300):
        data = bytes(RANDOM.choice(b"a\xc3\xa9\xe6\xbc\xa2\xf0\x9f\x98\x80\xff\xc0\xed\xa0") for _ in range(RANDOM.randint(0, 30)))
        machine, out, at = byte_bpe.Utf8Machine(), "", 0
        while at < len(data):
            step = RANDOM.randint(1, 4)
            out += machine.feed(data[at : at + step])
            at += step
        assert out + machine.end() == data.decode("utf-8", "replace")


def test_query_equals_the_library(spark, sf_dir):
    rows = {r.doc_id: r for r in registry.QUERIES["op2_byte_bpe"](spark, sf_dir).collect()}
    docs = table(spark, sf_dir, "documents").collect()
    assert len(rows) == len(docs)
    for r in docs:
        ids = LIBRARY.encode_ordinary(r.text or "")
        got = rows[r.doc_id]
        assert (got.n_tokens, got.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() and got.same_text


def test_long_texts_are_cut_where_a_match_begins():
    for text in TEXTS:
        parts = list(pieces(text, 64))
        assert "".join(parts) == text
        assert [i for p in parts for i in LIBRARY.encode_ordinary(p)] == LIBRARY.encode_ordinary(text)


def test_decoding_in_chunks_within_characters():
    ids = LIBRARY.encode_ordinary("😀é漢字 and more")
    decoder = Decoder({i: b for b, i in RANKS.items()})
    assert "".join(decoder.feed([i])[1] for i in ids) + decoder.end() == "😀é漢字 and more"
    decoder.feed([RANKS[b"\xf0"]])
    assert decoder.end() == "�"


def test_digests_and_columns(make_docs):
    rows = [(i, t) for i, t in enumerate(TEXTS[:12])] + [(100, None), (100, None)]
    got = by_id(digests(make_docs(rows)), "n_tokens", "ids_sha256", "decoded_sha256", "same_text")
    for i, text in rows:
        ids = LIBRARY.encode_ordinary(text or "")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[i] == (len(ids), sha(" ".join(map(str, ids))), sha(text or ""), True)
    assert by_id(digests(make_docs(rows), lasting=False, memory=1 << 20), "n_tokens", "ids_sha256", "decoded_sha256", "same_text") == got
    assert digests(make_docs(rows)).count() == len(rows) and digests(make_docs(rows).where("false")).count() == 0
    docs = make_docs(rows)
    back = docs.select("doc_id", "text", decoded_text(token_ids(docs["text"])).alias("back")).collect()
    assert all(r.back == (r.text or "") for r in back)


def test_the_pipeline_leaves_room_beside_what_other_stages_hold():
    """Two workers' tables, at 192 MB each, took an executor over its limit."""
    import corpus_pipeline

    assert corpus_pipeline.ENCODER_MEMORY <= 96 << 20
    words = byte_bpe.Words(Transducer(RANKS, corpus_pipeline.ENCODER_MEMORY), corpus_pipeline.ENCODER_MEMORY)
    assert words.transducer.most + words.transducer.most_pairs + words.most <= 96 << 20
