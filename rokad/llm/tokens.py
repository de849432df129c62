"""Token counts and ids by whole-token shortcut.

A text is cut at ASCII white space, where no normalisation, pre-token or merge of the tokenizer reaches across; each
distinct piece is normalised and pre-tokenised once. A pre-token that is proven to encode alone as one token
counts directly; only the others go through the merges.
"""
from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Recent, forget

WORD_BPE = "word_bpe_49k.json"
WORD_END = "</w>"
#: Characters whose composition and lower case are single and unconditional: ASCII and the Latin-1 letters.
_PLAIN = re.compile("[\x00-\x7fÀ-ÖØ-öø-ÿ]*")
#: The file's own pre-token pattern, restricted to those characters.
_PRETOKENS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+", re.ASCII)
#: Pieces of printable ones among those characters.
_PLAIN_PIECE = "^[\x21-\x7eÀ-ÖØ-öø-ÿ]*$"
#: The same over pieces that stand in lines of their own; a line's end is a match too.
_PRETOKENS_OF_LINES = re.compile(_PRETOKENS.pattern + "|\n", re.ASCII)
_PRETOKEN_RULE = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def tokenizer_path(name: str) -> str:
    """A file of public_tokenizers by name, or a path as it is."""
    if "/" in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte: itself where it is visible."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Encoder:
    """Ids of white-space-free pieces, remembered up to a bound (module-wide, so for all tasks of a worker)."""

    limit = 150_000

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        rules = [p.get("pattern", {}).get("Regex") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        if _PRETOKEN_RULE not in rules or spec["model"].get("end_of_word_suffix") != WORD_END:
            raise ValueError(f"{path}: not a word-end BPE with the pre-token rule this encoder proves its shortcut for")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.letters = {i: c for i, c in enumerate(byte_letters())}
        self.whole = self.prove_whole(spec["model"]["vocab"])
        self.model = self.tok.model
        self.merged = Recent(self.merge, self.limit)
        self.plain = Recent(self.merge_plain, self.limit)
        self.ids = Recent(self.encode_piece, self.limit)
        self.counts = Recent(lambda raw: len(self.encode_piece(raw)) // 4, self.limit)

    def prove_whole(self, vocab: dict[str, int]) -> dict[str, int]:
        """Vocabulary strings that, alone, encode to exactly their own id."""
        out = {}
        for token, own in vocab.items():
            if token.endswith(WORD_END) and len(token) > len(WORD_END):
                got = self.tok.model.tokenize(token[: -len(WORD_END)])
                if len(got) == 1 and got[0].id == own:
                    out[token[: -len(WORD_END)]] = own
        return out

    def pretokens(self, raw: bytes) -> list[str]:
        """Byte-level spellings of the pre-tokens of one piece without special strings."""
        if raw.isalpha():
            return [raw.lower().decode()]
        piece = raw.decode()
        if _PLAIN.fullmatch(piece):
            found = _PRETOKENS.findall(piece.lower())
            return found if raw.isascii() and piece.isprintable() else [x.encode().decode("latin-1").translate(self.letters) for x in found]
        return [x for x, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(piece))]

    def merge(self, pre: str) -> bytes:
        """Ids of one pre-token: its own where it is proven whole, else by the merges."""
        own = self.whole.get(pre)
        return array("I", [own] if own is not None else [t.id for t in self.model.tokenize(pre)]).tobytes()

    def encode_piece(self, raw: bytes) -> bytes:
        if b"<" in raw and any(s in raw.decode() for s in self.special):
            return array("I", self.tok.encode(raw.decode(), add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.merged.__getitem__, self.pretokens(raw)))

    def count(self, text: str) -> int:
        """Number of tokens of a text."""
        return sum(map(self.counts.__getitem__, text.encode().split()))

    def encode(self, text: str) -> bytes:
        """Ids of a text as unsigned 32-bit integers in this machine's order, which is little-endian on what Spark runs on."""
        return b"".join(map(self.ids.__getitem__, text.encode().split()))

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts one after another, and each text's number of ids; equal pieces are encoded once per call, nulls have none."""
        cut = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = cut.flatten().dictionary_encode()
        if not len(coded):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        ids, starts, sizes = self.encode_pieces(coded.dictionary)
        place = coded.indices.to_numpy()
        starts, n = starts[place], sizes[place]
        ends = np.cumsum(n)
        rows = np.cumsum(pc.list_value_length(cut).to_numpy())
        per_text = np.diff(np.r_[0, ends][np.r_[0, rows]])
        return ids[np.repeat(starts - (ends - n), n) + np.arange(ends[-1])], per_text

    def encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces in some order, where each piece's begin, and how many they are. Pieces of plain characters are cut by one scan over all of them."""
        plain = pc.match_substring_regex(pieces, _PLAIN_PIECE)
        if self.special:
            marked = [pc.match_substring(pieces, x) for x in self.special]
            plain = pc.and_not(plain, reduce(pc.or_, marked))
        plain = plain.to_numpy(zero_copy_only=False)
        lines = "\n".join([*pieces.filter(pa.array(plain)).to_pylist(), ""]).lower()
        found = _PRETOKENS_OF_LINES.findall(lines)
        encoded = list(map(self.plain.__getitem__, found))
        upto = np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4)
        ends = upto[np.fromiter(map("\n".__eq__, found), bool, len(found))]
        other = [self.encode_piece(x.encode()) for x in pieces.filter(pa.array(~plain)).to_pylist()]
        sizes, starts = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        sizes[plain], sizes[~plain] = np.diff(np.r_[0, ends]), np.fromiter(map(len, other), np.int64, len(other)) // 4
        begin = np.cumsum(np.r_[sizes[plain], sizes[~plain]]) - np.r_[sizes[plain], sizes[~plain]]
        starts[plain], starts[~plain] = begin[: len(ends)], begin[len(ends):]
        return np.frombuffer(b"".join([*encoded, *other]), np.uint32), starts, sizes

    def merge_plain(self, pre: str) -> bytes:
        """Ids of a lower-case pre-token of plain characters; none for the end of a line between pieces."""
        if pre == "\n":
            return b""
        return self.merge(pre if pre.isascii() else pre.encode().decode("latin-1").translate(self.letters))


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str = WORD_BPE) -> Encoder:
    """The encoder of this process for a tokenizer file."""
    if name not in _ENCODERS:
        forget()  # a worker that turns to tokens has no use for what other operators remembered
        _ENCODERS[name] = Encoder(tokenizer_path(name))
    return _ENCODERS[name]


def count_tokens(docs: DataFrame, tokenizer: str = WORD_BPE, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row.

    Null text counts as empty: no byte, no token. Repeated rows and null ids give one row each; other columns are ignored;
    an empty table gives an empty result. Texts of any length are read whole, in white-space-free pieces.
    """
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [enc.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()),
                pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast(T.LongType()), F.col("text")).mapInArrow(run, schema)
