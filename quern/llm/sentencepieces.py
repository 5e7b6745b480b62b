"""SentencePiece encoding and decoding on the tokenizers library (operator 3).

The model protobuf gives the pieces, scores and normaliser flags. From these
``rebuild`` makes a Tokenizer: a unigram model with the scores, or, for a BPE
model (the public 32k model is one), merges ranked by the score of the piece
that they make; byte fallback; the character map and blank rules of the
normaliser; and the metaspace marker. Batches are encoded and decoded on the
library's threads.

Ids come from the rebuilt Tokenizer. Parity: every distinct chunk is also encoded by
SentencePiece when it is first met, and ``parity`` is false for the texts that hold a chunk
where the two differ. Its ids are decoded then, too: only texts that hold a chunk which they
don't give back are decoded as a whole by ``round_trip``. Chunks start at marks: a model with
a piece that has a mark after another character is encoded without cutting.

Cases: null and empty texts have no tokens; an empty table gives no rows; ids, hashes and flags do not
depend on other rows, so repeated rows and clashing column names are free.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.common import begin, holder, keyed, read
from quern.llm.pieces import MARK, ChunkCache, in_turns, marked_chunks

UNIGRAM, BPE = 1, 2
ONE_IN = 1  # every distinct chunk; a caller may ask for one in so many, by a hash of the chunk
KNOWN_CHUNKS = 800_000  # about 150 MB a worker
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


def parse(path: str):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return model


def merges(model) -> list[tuple[str, str]]:
    """Pairs of pieces, best first by the score of what they make."""
    score = {p.piece: p.score for p in model.pieces if p.type in (NORMAL, USER)}
    found = []
    for piece, s in score.items():
        for i in range(1, len(piece)):
            if piece[:i] in score and piece[i:] in score:
                found.append((-s, score[piece[:i]] + score[piece[i:]], piece[:i], piece[i:]))
    found.sort(key=lambda x: (x[0], -x[1]))
    return [(a, b) for *_, a, b in found]


def rebuild(model):
    """A Tokenizer for text whose blanks are marked already (see ``mark``)."""
    from tokenizers import Tokenizer, decoders, models, normalizers

    fallback = any(p.type == BYTE for p in model.pieces)
    unk = model.trainer_spec.unk_id
    if model.trainer_spec.model_type == UNIGRAM:
        tok = Tokenizer(models.Unigram([(p.piece, p.score) for p in model.pieces], unk_id=unk, byte_fallback=fallback))
    elif model.trainer_spec.model_type == BPE:
        vocab = {p.piece: i for i, p in enumerate(model.pieces)}
        tok = Tokenizer(models.BPE(vocab, merges(model), unk_token=model.pieces[unk].piece, fuse_unk=True, byte_fallback=fallback))
    else:
        raise ValueError("only unigram and BPE models can be rebuilt")
    if model.normalizer_spec.precompiled_charsmap:
        tok.normalizer = normalizers.Precompiled(model.normalizer_spec.precompiled_charsmap)
    tok.decoder = decoders.Sequence([
        decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(),
        *([decoders.Strip(" ", 1, 0)] if model.normalizer_spec.add_dummy_prefix else [])])
    return tok


def mark(model, text: str) -> str:
    """The normaliser's blank rules and marker."""
    spec = model.normalizer_spec
    if spec.remove_extra_whitespaces:
        text = " ".join(x for x in text.split(" ") if x)
    if not text:
        return ""
    if spec.add_dummy_prefix:
        text = " " + text
    return text.replace(" ", MARK) if spec.escape_whitespaces else text


class Codec:
    """Encodes and decodes texts of one model, noting chunks without parity and those that decoding doesn't give back."""

    def __init__(self, path: str, one_in: int = ONE_IN):
        # A small pool: more threads than a task's cores only wait for each other.
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        import sentencepiece

        self.model = parse(path)
        self.tok = rebuild(self.model)
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.whole = bool(self.model.normalizer_spec.precompiled_charsmap) or any(MARK in p.piece.lstrip(MARK) for p in self.model.pieces)
        self.bytes = np.array([p.type == BYTE for p in self.model.pieces])
        self.one_in = one_in
        self.bad: set[str] = set()
        self.lost: set[str] = set()
        self.mark_id = self.tok.token_to_id(MARK)
        self.cache = ChunkCache(self._encode, KNOWN_CHUNKS)

    def _plain(self, chunk: str) -> str:
        text = chunk.replace(MARK, " ")
        return text[1:] if self.model.normalizer_spec.add_dummy_prefix and text[:1] == " " else text

    def _encode(self, chunks: list[str]) -> list[list[int]]:
        ours = [e.ids for e in self.tok.encode_batch_fast(chunks, add_special_tokens=False)]
        asked = range(len(chunks)) if self.one_in == 1 else [k for k, c in enumerate(chunks) if zlib.crc32(c.encode("utf-8", "surrogatepass")) % self.one_in == 0]
        theirs = self.sp.encode([self._plain(chunks[k]) for k in asked], num_threads=1)
        self.bad = {c for c in self.bad if c in self.cache.ids}
        for k, t in zip(asked, theirs, strict=True):
            # A lone mark can't be asked for: SentencePiece adds one itself to any text that isn't empty.
            if ours[k] != ([self.sp.piece_to_id(MARK)] if chunks[k] == MARK else t):
                self.bad.add(chunks[k])
        self.lost = {c for c in self.lost if c in self.cache.ids}
        # A mark before each, as the decoder may strip one; without such a piece all texts are decoded as a whole.
        back = self.tok.decode_batch([[self.mark_id, *i] for i in ours], skip_special_tokens=False) if self._by_chunk else []
        blank = "" if self._stripped else " "
        self.lost.update(c for c, b in zip(chunks, back) if b != blank + c.replace(MARK, " "))
        return ours

    @property
    def _stripped(self) -> bool:
        return self.model.normalizer_spec.add_dummy_prefix

    @property
    def _by_chunk(self) -> bool:
        return self.mark_id is not None and not self.whole

    def decodes(self, texts: list[str], ids: list[bytes]) -> list[bool]:
        """Whether the ids, as encode has just given them for these texts, decode to the texts."""
        out, asked = [False] * len(texts), []
        for k, t in enumerate(texts):
            marked = mark(self.model, t)
            if self._by_chunk and (not self.lost or self.lost.isdisjoint(marked_chunks(marked))):
                back = marked.replace(MARK, " ")
                out[k] = (back[1:] if self._stripped and back[:1] == " " else back) == t
            else:
                asked.append(k)
        for k, back in zip(asked, self.decode([ids[k] for k in asked]), strict=True):
            out[k] = back == texts[k]
        return out

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """ids as little-endian 32-bit bytes, and whether both libraries agree on every chunk that was checked."""
        marked = [mark(self.model, t) for t in texts]
        chunked = [[t] if self.whole and t else marked_chunks(t) for t in marked]
        ids = self.cache.texts(chunked)
        return ids, [not self.bad or self.bad.isdisjoint(c) for c in chunked]

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.tok.decode_batch([np.frombuffer(i, "<u4").tolist() for i in ids], skip_special_tokens=False)


_codecs: dict[str, Codec] = {}
holder("sentencepiece", _codecs.clear)


def codec(path: str) -> Codec:
    begin("sentencepiece")
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, th, ids (binary, little-endian 32-bit), parity."""

    def run(batches):
        c = codec(path)
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, j in in_turns(texts):
                ids, ok = c.encode(texts[i:j])
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in ("doc_id", "th")), pa.array(ids, pa.binary()), pa.array(ok)], ["doc_id", "th", "ids", "parity"])

    return keyed(docs).mapInArrow(run, "doc_id long, th long, ids binary, parity boolean")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, th, text."""

    def run(batches):
        c = codec(path)
        for b in batches:
            texts = c.decode(b.column("ids").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(texts, pa.string())], ["doc_id", "th", "text"])

    return encoded.select("doc_id", "th", "ids").mapInArrow(run, "doc_id long, th long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, n_bytes (byte-fallback tokens), ids_crc32, decodes (back to the text exactly), parity."""

    def run(batches):
        c = codec(path)
        names = ["doc_id", "n_tokens", "n_bytes", "ids_crc32", "decodes", "parity"]
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, j in in_turns(texts):
                ids, ok = c.encode(texts[i:j])
                back = c.decodes(texts[i:j], ids)
                bytes_ = [int(c.bytes[np.frombuffer(x, "<u4")].sum()) for x in ids]
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id").slice(i, j - i), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(bytes_, pa.int64()),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(back), pa.array(ok)], names)

    return keyed(docs).mapInArrow(run, "doc_id long, n_tokens long, n_bytes long, ids_crc32 long, decodes boolean, parity boolean")


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
