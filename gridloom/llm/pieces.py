"""SentencePiece BPE encoding and decoding by a table of each prefix's last token.

Of all ways to cut a string into pieces exactly one is what merging by score gives, and it is the only
one in which every two neighbours are *compatible*: merged on their own, they come out as the same two
pieces.  So each prefix of a string has a unique last token, and it is found from left to right: an
automaton reports all pieces that end at a position, and the one whose left neighbour (the stored last
token of the prefix before it) is compatible with it is stored.  The ids are then read backwards.

White space becomes U+2581, one is put in front of a text, and no piece has it after another
character; so a text falls apart before each run of it, and each part is encoded once per task and
remembered in a table of bounded size.  A character that is in no piece is one symbol and is written
as its bytes' pieces.  Null counts as empty, and an empty text has no ids.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows

MARK = "▁"
NEVER = float("-inf")
UNKNOWN = 1 << 20  # stands for a character that is in no piece
PART = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@dataclass(frozen=True)
class Vocabulary:
    """The pieces of a model by id, their scores, and the ids of the pieces that stand for bytes."""

    name: str
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    ordinary: tuple[bool, ...]
    bytes_: tuple[int, ...]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a model file.  This is the only use of the library: it reads the list of pieces."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        special = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        found = {model.id_to_piece(i): i for i in ids if model.is_byte(i)}
        name = hashlib.sha256(model.serialized_model_proto()).hexdigest()
        return cls(name, tuple(map(model.id_to_piece, ids)), tuple(map(model.get_score, ids)), tuple(not special(i) for i in ids), tuple(found[f"<0x{b:02X}>"] for b in range(256)))


class Codec:
    """Encodes and decodes with a vocabulary; one per task."""

    def __init__(self, vocabulary: Vocabulary, pairs: int = 400_000) -> None:
        self.vocabulary, self.limit = vocabulary, pairs
        self.id_of = {p: i for i, p in enumerate(vocabulary.pieces) if vocabulary.ordinary[i]}
        self.tokens = list(vocabulary.pieces)
        self.automaton = ahocorasick.Automaton()
        self.length = [len(p) for p in vocabulary.pieces]
        for p, i in self.id_of.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.surface = [p.replace(MARK, " ").encode("utf-8") if vocabulary.ordinary[i] else b"" for i, p in enumerate(vocabulary.pieces)]
        for b, i in enumerate(vocabulary.bytes_):
            self.surface[i] = bytes([b])
        self.fits: dict[int, bool] = {}
        self.alone: list = [None] * len(self.tokens)
        self.neighbours = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)}
        self.score_of = {p: vocabulary.scores[i] for p, i in self.id_of.items()}.get

    def history(self, token: int) -> tuple[bool, list[float], list[str], list[str]]:
        """How a piece's own string is merged, best score first and leftmost among equals.

        Whether it ends as that piece; the scores of its merges in order, closed by minus infinity;
        and its first and its last symbol before each merge and at the end.
        """
        found = self.alone[token]
        if found is None:
            score, id_of = self.vocabulary.scores, self.id_of
            symbols = list(self.tokens[token])
            merges, first, last = [], [symbols[0]], [symbols[-1]]
            while True:
                best, at = None, -1
                for k in range(len(symbols) - 1):
                    i = id_of.get(symbols[k] + symbols[k + 1])
                    if i is not None and (best is None or score[i] > best):
                        best, at = score[i], k
                if at < 0:
                    break
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
                merges.append(best)
                first.append(symbols[0])
                last.append(symbols[-1])
            merges.append(NEVER)
            found = self.alone[token] = len(symbols) == 1, merges, first, last
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two pieces' strings, merged side by side, never merge across their border.

        Both histories are replayed together, the better score first and the left one among equals;
        at each moment the symbols at the border would merge if their piece beat both next merges.
        """
        key = left << 32 | right
        alone, b, starts, _ = self.alone[right] or self.history(right)
        if alone and left != UNKNOWN:
            _, a, _, ends = self.alone[left] or self.history(left)
            score = self.score_of
            i = j = 0
            x, y, p, q = ends[0], starts[0], a[0], b[0]
            while True:
                across = score(x + y)
                if across is not None and across > p and across >= q:
                    alone = False
                    break
                if p >= q:
                    if p == NEVER:
                        break
                    i += 1
                    x, p = ends[i], a[i]
                else:
                    j += 1
                    y, q = starts[j], b[j]
        if len(self.fits) >= self.limit:
            self.fits.clear()
        self.fits[key] = alone
        return alone

    def runs(self, part: str) -> list[str]:
        """Cut a string where two characters meet that are neighbours in no piece: nothing merges there."""
        near = self.neighbours
        cuts = [i for i in range(1, len(part)) if part[i - 1 : i + 1] not in near]
        if not cuts:
            return [part]
        return [part[a:b] for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True)]

    def encode_run(self, part: str) -> list[int]:
        """Ids of a string by its prefixes' last tokens; a character in no piece becomes its bytes."""
        last: list = [None] * len(part)
        known, length = self.fits.get, self.length
        for end, token in self.automaton.iter(part):
            if last[end] is not None:
                continue
            start = end - length[token]
            if start < 0:
                alone = self.alone[token] or self.history(token)
                if alone[0]:
                    last[end] = token
                continue
            before = last[start]
            if before is None:
                before = UNKNOWN
            ok = known(before << 32 | token)
            if ok or ok is None and self.compatible(before, token):
                last[end] = token
        ids = []
        at = len(part) - 1
        while at >= 0:
            token = last[at]
            if token is None:
                ids.extend(self.vocabulary.bytes_[b] for b in reversed(part[at].encode("utf-8", "surrogatepass")))
                at -= 1
            else:
                ids.append(token)
                at -= length[token]
        ids.reverse()
        return ids

    def encode_part(self, part: str) -> list[int]:
        return [i for run in self.runs(part) for i in self.encode_run(run)]

    def encode(self, text: str) -> list[int]:
        """Ids of a text."""
        return [i for part in parts(text) for i in self.encode_part(part)]

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The bytes of some ids, each U+2581 as a space, with the space put in front still there."""
        surface = self.surface
        return b"".join([surface[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """The text of some ids: without the first space, bytes that are no UTF-8 as U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace").removeprefix(" ")


def parts(text: str | None) -> list[str]:
    return PART.findall(MARK + text.replace(" ", MARK)) if text else []


class Memory(dict):
    """What each part of a text is encoded to: ids joined by commas, and the bytes they decode to."""

    def __init__(self, codec: Codec, most: int = 300_000, longest: int = 48) -> None:
        self.codec, self.most, self.longest = codec, most, longest

    def __missing__(self, part: str) -> tuple[str, bytes]:
        runs = self.codec.runs(part)
        if len(runs) == 1:
            ids = self.codec.encode_run(part)
            out = ",".join(map(str, ids)), self.codec.decode_bytes(ids)
        else:
            found = [self[r] for r in runs]
            out = ",".join([f[0] for f in found]), b"".join([f[1] for f in found])
        if len(part) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[part] = out
        return out


_held: dict[str, Memory] = {}


def memory_of(vocabulary: Vocabulary) -> Memory:
    """This process's memory for a vocabulary; tasks that follow each other in a worker share it."""
    if vocabulary.name not in _held:
        _held.clear()
        _held[vocabulary.name] = Memory(Codec(vocabulary))
    return _held[vocabulary.name]


def encode_decode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each document; rows are not moved."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a model's list of pieces, of fixed size

    def make():
        memory = memory_of(sent.value)

        def step(x):
            n, ids_hash, text_hash = [], [], []
            for text in x["_t"]:
                found = [memory[p] for p in parts(text)]
                ids = ",".join([f[0] for f in found])
                n.append(ids.count(",") + 1 if ids else 0)
                ids_hash.append(hashlib.sha256(ids.encode()).hexdigest())
                text_hash.append(hashlib.sha256(b"".join([f[1] for f in found])[1:]).hexdigest())
            return {"id": x["_i"], "n_tokens": n, "ids_sha256": ids_hash, "decoded_sha256": text_hash}

        return step

    got = map_rows(docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t")), make, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return got.withColumnRenamed("id", id_col)


def encode_texts(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", ids_col: str = "ids", kept: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``kept`` of the documents with their ids as an array."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = docs.select(*kept).schema.add(ids_col, T.ArrayType(T.IntegerType()))

    def make():
        memory = memory_of(sent.value)

        def step(x):
            ids = [[int(i) for p in parts(t) for i in memory[p][0].split(",")] for t in x[text_col]]
            return {**{k: x[k] for k in kept}, ids_col: ids}

        return step

    return map_rows(docs.select(*dict.fromkeys((*kept, text_col))), make, schema)


def decode_ids(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", text_col: str = "text", kept: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``kept`` with the text that the ids stand for."""
    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    schema = encoded.select(*kept).schema.add(text_col, "string")

    def make():
        codec = memory_of(sent.value).codec
        return lambda x: {**{k: x[k] for k in kept}, text_col: [codec.decode(i or []) for i in x[ids_col]]}

    return map_rows(encoded.select(*kept, ids_col), make, schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_decode(docs, Vocabulary.load(model or default_model()))
