import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from logloom.llm import coder, tokens
from tests.llm.helpers import LONG, clashing, docs

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "It's <|endoftext|> a_b 'sam \"'s 12 ½", None, "", "don't WE'LL __x__ 3.14 ... Çà", "İstanbul ſ ŉ", "x'y'z's'st''s", "“quoted” – it’s…", "\x1cabc\x85d\xa0e",
    "日本語 テスト", LONG, "same", "same", "!!! ### é" * 300,
]


@pytest.mark.parametrize("lengths", [[], [1], [1024, 1024, 7], [300]])
def test_coder_round_trip(lengths):
    rng = np.random.default_rng(len(lengths))
    for draw in (lambda n: rng.integers(0, 1 << 16, n), lambda n: np.full(n, 65535), lambda n: np.arange(n) % 5, lambda n: np.minimum(rng.zipf(1.3, n), 65535)):
        blocks = [draw(n) for n in lengths]
        found = coder.decode(coder.encode(blocks), lengths)
        assert all(np.array_equal(a, b) for a, b in zip(blocks, found)) and len(found) == len(blocks)


def test_blocks_are_independent_and_checked():
    rows = [np.arange(3000) % 700, np.array([1]), np.arange(50)]
    data = tokens.MAGIC + tokens.pack([4, None, 6], rows)
    assert [(i, list(x)) for i, x in tokens.unpack(data)] == [(i, list(x)) for i, x in zip([4, None, 6], rows)]
    block = np.arange(1000) % 37
    assert coder.encode([block, block])[1] == coder.encode([block])[0]
    with pytest.raises(ValueError):
        list(tokens.unpack(data[:-400] + bytes(400)))


def test_words_encode_like_whole_texts(spark):
    table = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts = [t or "" for t in TEXTS + table]
    plain, encoder = Tokenizer.from_file(PATH), tokens.Encoder(PATH)
    for _ in range(2):
        assert [list(x) for x in encoder.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_files_hold_every_document(spark, tmp_path):
    plain = Tokenizer.from_file(PATH)
    rows = [(i * 7 % 13, t) for i, t in enumerate(TEXTS)] + [(3, "again"), (None, "no id")]
    table = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    folder = str(tmp_path / "files")
    manifest = tokens.write(table, folder, PATH, group=500, size=1500)
    got = tokens.read(manifest, folder).orderBy("start").collect()
    assert set(os.listdir(folder)) == {*(r.name for r in manifest.collect()), "manifest"}
    start, want = 0, []
    for doc_id, text in rows:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want.append((doc_id, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got)
    for r in got:
        assert r.start == start
        start += r.n_tokens
    order = [r.doc_id for r in got]
    assert order[0] is None and order[1:] == sorted(order[1:])


def test_empty_table(spark):
    assert tokens.tokenized(docs(spark, []), PATH).count() == 0


def test_a_group_is_coded_in_passes_of_like_size(monkeypatch):
    """A few blocks beyond LANES took a pass of their own, as long as a whole one."""
    passes, predict = [], coder._Model.predict
    monkeypatch.setattr(coder, "LANES", 4)
    monkeypatch.setattr(coder._Model, "predict", lambda self, n: (passes.append(n), predict(self, n)))
    rows = [np.arange(4 * coder.BLOCK + 9) % 300]
    assert np.array_equal(next(tokens.unpack(tokens.MAGIC + tokens.pack([1], rows)))[1], rows[0])
    assert len(passes) <= 2 * coder.BLOCK and [coder.lanes(n) for n in (0, 1, 4, 5, 6, 7, 12)] == [1, 1, 4, 5, 3, 4, 4]


def test_ids_are_coded_by_the_frequencies_of_their_group():
    rng = np.random.default_rng(3)
    stream = np.minimum(rng.zipf(1.2, 200 * coder.BLOCK), 50_000).astype(np.uint32)
    often = coder.Frequencies.of(stream)
    again = coder.Frequencies.load(often.dump())
    assert np.array_equal(again.ids, often.ids) and np.array_equal(again.parts, often.parts) and often.parts.sum() <= 1 << 18
    counts = np.bincount(stream)
    best = -(counts[counts > 0] * np.log2(counts[counts > 0] / len(stream))).sum() / 8
    data = tokens.pack([1], [stream])
    assert len(data) < 1.2 * best  # every block learned them anew before, and took more
    assert np.array_equal(next(tokens.unpack(tokens.MAGIC + data))[1], stream)


def test_carries_pass_through_full_words():
    out = np.array([5, 0xFFFFFFFF, 0xFFFFFFFF, 7, 8], dtype="<u4")
    coder._carry(out, np.array([2, 4]))
    assert out.tolist() == [6, 0, 0, 7, 9]


def test_workers_forget_their_words_with_the_task(spark, tmp_path):
    tokens.write(docs(spark, [f"word{k} other{k}" for k in range(400)]), str(tmp_path / "files"), PATH).count()

    def held(batches):
        for batch in batches:
            yield batch.set_column(0, "id", __import__("pyarrow").array([len(tokens._encoder(PATH, True).words)] * batch.num_rows, "int64"))

    assert {r.id for r in spark.range(0, 64, 1, 16).mapInArrow(held, "id long").collect()} == {0}


def test_a_piece_is_asked_of_the_tokenizer_once(monkeypatch):
    """Each stretch between white space was asked for, so a word was asked again with every sign beside it."""
    asked, whole = [], tokens.Encoder._whole
    monkeypatch.setattr(tokens.Encoder, "_whole", lambda self, texts: asked.extend(texts) or whole(self, texts))
    encoder, texts = tokens.Encoder(PATH), ["Émile, émile. (émile) émile's", "l'émile 42 émile!"]
    found = encoder.encode(texts) + encoder.encode(texts)
    assert " ".join(asked).split() == ["émile", ",", ".", "(", ")", "'s", "l", "'", "4", "2", "!"]
    assert [list(x) for x in found] == 2 * [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_pieces_of_all_plain_characters():
    letters = [c for c in map(chr, range(0x2100)) if tokens._PLAIN.fullmatch(c)]
    rng = np.random.default_rng(5)
    texts = letters + ["".join(rng.choice([*letters, *"''''  \n_stmdrevl"], 40)) for _ in range(2000)]
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert [list(x) for x in tokens.Encoder(PATH).encode(texts)] == want


def test_blocks_are_coded_as_before():
    """Files of the same form hold the same bytes, whatever the model's layout in memory."""
    rng = np.random.default_rng(11)
    blocks = [np.minimum(rng.zipf(1.3, n), 65535) for n in (1024, 1024, 700)] + [np.arange(90) % 7]
    assert zlib.crc32(b"".join(coder.encode(blocks))) == 2339217934
