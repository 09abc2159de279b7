"""SentencePiece (1) and SSTable shards (6), against the libraries."""

from __future__ import annotations

import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.llm import sentencepiece_codec as sp
from paperloom.llm import sstable
from paperloom.llm.common import scratch_path
from paperloom.llm.registry import tokenizer_path

PIECES, WORDS = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("word_bpe_49k.json")
LETTERS = st.text(alphabet="aeths THE.\n▁é日0<>|_\t́ſΣ'", max_size=80)


@settings(max_examples=300, deadline=None)
@given(st.lists(LETTERS, max_size=5))
def test_pieces_equal_the_library(texts):
    own = sp.codec(PIECES)
    said = own.library.encode(texts)
    assert own.encode(texts) == said
    assert [x for t in texts for r in own.model.runs(t) for x in own.model.merge(r)] == [x for ids in said for x in ids]


def test_long_runs_and_forgetting(monkeypatch):
    monkeypatch.setattr(sp, "REMEMBER_RUNS", 3)
    own = sp.Codec(PIECES, "texts")
    texts = ["a" * 3000, " " * 500, "the ships were here", "", "x y z w v", "\x00\n\n"]
    assert own.encode(texts) == own.library.encode(texts)


def test_a_wrong_agenda_is_found(monkeypatch):
    own = sp.Codec(PIECES, "runs")
    monkeypatch.setattr(own.model, "merge_many", lambda runs: sp.MergeModel.merge_many(own.model, [r[:-1] for r in runs]))
    with pytest.raises(ValueError, match="differ"):
        own.encode(["ships were here"])


PARTS = st.sampled_from(["▁the", "ships", "été", "Ein", "''", ",", ".", "***", "(", "12", "\n", " ", "  ", "日本", "e\u0301", "\x00", "🙂", "<0x0A>", "x" * 70])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=20).map("".join), max_size=5))
def test_cuts_within_words_equal_the_library(texts):
    own = sp.codec(PIECES, "texts")
    assert own.encode(texts) == own.library.encode(texts)


def _merged(own, monkeypatch):
    asked, merge = [], own.model.merge_many
    monkeypatch.setattr(own.model, "merge_many", lambda runs: asked.extend(runs) or merge(runs))
    return asked


def test_words_with_marks_behind_them_are_merged_once(monkeypatch):
    own = sp.Codec(PIECES, "runs")
    asked = _merged(own, monkeypatch)
    texts = ["zships, zships. zships*** (zships) zships!?", "zships; zships\n zships@@"]
    assert own.encode(texts) == own.library.encode(texts)
    assert sorted(r for r in asked if "zships" in r) == [" zships", "zships"] and len(asked) == len(set(asked))


def test_a_full_table_keeps_what_is_met_often(monkeypatch):
    monkeypatch.setattr(sp, "REMEMBER_RUNS", 20)
    own = sp.Codec(PIECES, "runs")
    asked = _merged(own, monkeypatch)
    for k in range(40):
        texts = [f"zships {'qwrt'[k % 4]}{'aeiou' * (k + 1)}"]
        assert own.encode(texts) == own.library.encode(texts)
    assert asked.count(" zships") == 1 and len(own.words.place) < 30 and len(own.runs.place) < 30


def test_a_difference_leaves_nothing_behind(monkeypatch):
    own = sp.Codec(PIECES, "runs")
    with monkeypatch.context() as m:
        m.setattr(own.model, "merge_many", lambda runs: sp.MergeModel.merge_many(own.model, [r[:-1] for r in runs]))
        with pytest.raises(ValueError, match="differ"):
            own.encode(["ships were here"])
    assert own.encode(["ships were here"]) == own.library.encode(["ships were here"])


def test_a_wrong_cut_is_found(monkeypatch):
    own = sp.Codec(PIECES, "runs")
    monkeypatch.setattr(own.model.beside, "find", lambda a, b: sp.np.full(len(a), -1))
    with pytest.raises(ValueError, match="differ"):
        own.encode(["ships were here"])


def test_codec_on_rows(spark, odd_docs, clashing):
    library = sp.codec(PIECES).library
    out = sp.encode_decode(odd_docs, PIECES, outputs=("ids", "decoded", "n_tokens")).collect()
    assert len(out) == odd_docs.count()
    for r in out:
        assert r["ids"] == library.encode(r["text"] or "") and r["decoded"] == library.decode(r["ids"]) and r["n_tokens"] == len(r["ids"])
    wide = sp.encode_decode(clashing, PIECES, outputs=("ids", "n_tokens"))
    assert [c.lower() for c in wide.columns].count("n_tokens") == 1 and wide.where("doc_id = 8").first()["ids"] == library.encode("one")
    assert sp.encode_decode(odd_docs.limit(0), PIECES).count() == 0


@settings(max_examples=300, deadline=None)
@given(LETTERS)
def test_words_equal_the_library(text):
    own = sstable.word_ids(WORDS)
    assert own.values([text]) == [own.pack(own.library.encode(text, add_special_tokens=False).ids)]


def test_letters_whose_lower_case_is_more():
    """Every letter that isn't one letter in lower case or composed, and some that are, before stops and alone."""
    own = sstable.WordIds(WORDS)
    odd = [c for c in map(chr, range(0x20000)) if c.isalpha() and (len(c.lower()) > 1 or not c.lower().isalpha() or not sstable.normalize("NFC", c).isalpha())]
    assert "\u0130" in odd
    for c in [*odd, "\u00c9", "\u03a3", "\u01c5", "\u00df", "\u212b", "e\u0301", "\u1e9e"]:
        for text in (f"{c}. x", f"{c}, x", f"{c}", f"a{c}. B{c}", f"{c}a., {c}{c}.."):
            assert own.values([text]) == [own.pack(own.library.encode(text, add_special_tokens=False).ids)], text


def test_marks_that_only_small_letters_are_composed_with():
    own = sstable.WordIds(WORDS)
    for mark in ("\u0331", "\u0308", "\u030a", "\u030c", "\u0307", "\u0301", "\u0591\u030c"):
        for letter in "HTWYJIA":
            for text in (f"{letter}{mark}", f"x {letter}{mark}. {letter.lower()}{mark}", f"{letter}{mark}{letter}\n{letter}.", f"\u0370{letter}{mark}"):
                assert own.values([text]) == [own.pack(own.library.encode(text, add_special_tokens=False).ids)], text


def test_marks_behind_letters_stand_for_themselves(monkeypatch):
    """Words with marks behind them are led back to their letters, so the library gets those alone, and once."""
    own = sstable.WordIds(WORDS)
    monkeypatch.setattr(own, "_compare", lambda pieces, own: None)
    asked, said = [], own._said
    monkeypatch.setattr(own, "_said", lambda pieces: asked.extend(pieces) or said(pieces))
    texts = ["Ships!!! ships*** SHIPS'", "ships=, Ships_ ships...", "ships's *** don't! a!b ships<"]
    assert own.values(texts) == [own.pack(own.library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert set(asked) == {b"!!!", b"***", b"'", b"=,", b"_", b"...", b"ships's", b"don't!", b"a!b", b"ships<"} and len(asked) == len(set(asked))


def test_wrong_ids_of_a_whole_text_are_found(monkeypatch):
    own = sstable.WordIds(WORDS)
    monkeypatch.setattr(own, "words", lambda text: text.split(b" ")[:-1])
    with pytest.raises(ValueError, match="other ids"):
        own.values(["ships were here"])


def test_words_are_forgotten_and_known_again(monkeypatch):
    monkeypatch.setattr(sstable, "REMEMBER", 4)
    own = sstable.WordIds(WORDS)
    for text in ("ships were here, and there!", "Boats, were. there", "", "ships, boats! \u00e9t\u00e9. \u00c9t\u00e9*", "were were"):
        assert own.values([text, text]) == [own.pack(own.library.encode(text, add_special_tokens=False).ids)] * 2


def test_other_tokenizers_are_not_cut_at_blanks(tmp_path):
    import json

    rules = json.loads(open(WORDS, encoding="utf-8").read())
    rules["normalizer"]["normalizers"][1]["content"] = "  "
    (tmp_path / "other.json").write_text(json.dumps(rules))
    own = sstable.WordIds(str(tmp_path / "other.json"))
    assert not own.by_word and sstable.WordIds(WORDS).by_word
    assert own.values(["Two words."]) == [own.pack(own.library.encode("Two words.", add_special_tokens=False).ids)]


def test_special_tokens_in_texts():
    own = sstable.word_ids(WORDS)
    for text in ("<|endoftext|>", "a<|ENDOFTEXT|>b. c,", "x,<|startoftext|>. it's don't", "a..b ... A.,"):
        assert own.values([text]) == [own.pack(own.library.encode(text, add_special_tokens=False).ids)]


def test_shard_format():
    w = sstable.ShardWriter(1, 4)
    keys = [sstable.key_of(None), *[sstable.key_of(i) for i in range(-50, 3000, 3)], sstable.key_of(5000, 0), sstable.key_of(5000, 1)]
    for k, key in enumerate(keys):
        w.add(key, struct.pack("<2I", k, 1) * (1 + k % 40))
    data = w.finish()
    shard = sstable.Shard.of(data)
    assert [k for k, _ in shard.entries()] == keys == sorted(keys) and len(shard.index) > 2
    assert sstable.id_of(keys[1]) == -50 and sstable.id_of(keys[0]) is None
    assert len(shard.get(5000)) == 2 and len(shard.get(None)) == 1 and shard.get(1) == [struct.pack("<2I", 18, 1) * 19] and shard.get(2) == []
    assert shard.documents == len(keys)
    broken = bytearray(data)
    broken[10] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(sstable.Shard.of(bytes(broken)).entries())
    with pytest.raises(ValueError):
        sstable.Shard.of(data[:-1] + b"x")


def test_shards_on_rows(spark, odd_docs, monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    out = sorted(sstable.query(odd_docs.select("doc_id", "text"), WORDS).collect(), key=lambda r: r["start"])
    texts = {}
    for r in odd_docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        texts.setdefault(r["doc_id"], []).append((len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    start, last = 0, None
    for r in out:
        assert (r["n_tokens"], r["ids_crc32"]) in texts[r["doc_id"]] and r["start"] == start
        assert last is None or r["doc_id"] >= last
        start, last = start + r["n_tokens"], r["doc_id"]
    assert len(out) == odd_docs.count() and out[0]["doc_id"] is None
    assert sstable.query(odd_docs.select("doc_id", "text").limit(0), WORDS).count() == 0


def test_shards_are_read_a_block_at_a_time(spark, odd_docs):
    """Neither Spark nor a worker holds a whole shard; before, both did."""
    w, size = sstable.ShardWriter(1, 2), 40_000
    for k in range(250):
        w.add(sstable.key_of(k), struct.pack("<H", k) * (size // 2))
    data, asked = w.finish(), []
    whole = sstable.Shard.of(data).read
    groups = list(sstable.rows_of(sstable.Shard(lambda at, n: asked.append(n) or whole(at, n)), 7))
    assert [(i, s) for g in groups for i, s, _ in g] == [(k, 7 + k * size // 2) for k in range(250)]
    assert all(ids == struct.pack("<I", i) * (size // 2) for g in groups for i, _, ids in g)
    assert len(data) > 8 * sstable.READ_BYTES and max(asked) < sstable.BLOCK_BYTES + size + 1000
    assert max(sum(len(ids) for _, _, ids in g) for g in groups) < sstable.READ_BYTES + 2 * size + 1
    folder = scratch_path(spark, "blocks")
    manifest = sstable.write_shards(odd_docs, WORDS, folder)
    assert len(manifest.inputFiles()) == 1 < manifest.count()
    rows = sstable.read_shards(spark, folder, manifest)
    assert "binaryfile" not in rows._jdf.queryExecution().toString().lower() and rows.count() == odd_docs.count()


def test_a_word_is_looked_up_once_and_kept_only_if_new(monkeypatch):
    """Only words that aren't known are kept until the group is learnt."""

    class Known(dict):
        asked = 0

        def get(self, w):
            Known.asked += 1
            return super().get(w)

        def __getitem__(self, w):
            Known.asked += 1
            return super().__getitem__(w)

        def __contains__(self, w):
            Known.asked += 1
            return super().__contains__(w)

    own = sstable.WordIds(WORDS)
    own.values(["ships were here"])
    own.known = Known(own.known)
    monkeypatch.setattr(own, "_compare", lambda pieces, own: None)
    said = own.pack(own.library.encode("ships were here", add_special_tokens=False).ids)
    assert own.values(["ships were here"] * 10) == [said] * 10 and Known.asked == 30


def test_lookup_in_files(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("ship "), F.col("id").cast("string")).alias("text"))
    folder = scratch_path(spark, "lookup")
    files = [r["file"] for r in sstable.write_shards(docs, WORDS, folder).collect()]
    own = sstable.word_ids(WORDS)
    ids = own.library.encode("ship 77", add_special_tokens=False).ids + [1]
    assert sstable.lookup(folder, files, 77) == [struct.pack(f"<{len(ids)}I", *ids)] and sstable.lookup(folder, files, 777) == []
