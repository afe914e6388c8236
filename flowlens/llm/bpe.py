"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the bytes cuts every text where its content says so, so texts that share a passage share its
chunks. Chunks that occur more than once are encoded once, in a table; equal texts are encoded once, too. A cut may
fall inside a word, so a chunk's encoding covers the words that lie whole in it, and keeps the bytes before its first
and after its last white space. At a join those bytes are encoded again, over as many chunks as it takes to reach
white space on both sides. The tokenizer never joins text across white space, so there the tokens agree exactly.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import stored
from .shingles import mixed

#: A cut after about 2**BITS bytes, decided by the last 16 of them.
BITS = 10
#: Shared chunks are marked in a bitmap of fixed size; a chunk marked by chance only takes the longer way.
MARK_BITS, BUCKET = 26, 32768
#: Words that a task remembers at once.
REMEMBERED = 400_000
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Words beyond these letters are given to the tokenizer one by one.
PLAIN = re.compile(r"[\x21-\x7e¡-ɏ]+\Z")
#: The pattern of the tokenizer family this works for, and what it takes as one match or, with a stop, as two.
WORD_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
STOPS = ".,;:!?"
SIMPLE = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+[.,;:!?]?\Z")
GEAR = (mixed(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def cuts(raw: list[bytes], bits: int = BITS) -> list[list[bytes]]:
    """Chunks of each text; joined they are the text. Cuts stand between characters, none in the first 16 bytes."""
    a = np.frombuffer(b"".join(raw) + b"\0", dtype=np.uint8)
    h = GEAR[a]
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    at = np.flatnonzero((h[:-1] >> np.uint32(32 - bits)) == 0) + 1
    at = at[(a[at] & 0xC0) != 0x80]
    ends = np.cumsum([len(t) for t in raw])
    out = []
    for text, end in zip(raw, ends.tolist(), strict=True):
        start = end - len(text)
        inside = at[np.searchsorted(at, start + 16) : np.searchsorted(at, end)] - start
        edges = [0, *inside.tolist(), len(text)]
        out.append([text[x:y] for x, y in zip(edges[:-1], edges[1:], strict=True) if y > x])
    return out


def name(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def place(key: bytes) -> int:
    return int.from_bytes(key[:4], "little") & ((1 << MARK_BITS) - 1)


def as_bytes(texts: pd.Series) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def checked(definition: str) -> dict:
    """The definition, if encoding word by word gives what encoding the whole text gives; an error otherwise.

    It must be a BPE whose pre-tokenizer takes nothing but the matches of a pattern that matches no white space, whose
    normalizer looks at one character or at its marks, and which has neither a decoder nor a post-processor.
    """
    told = json.loads(definition)
    steps = lambda x, inner: [] if x is None else x[inner] if x["type"] == "Sequence" else [x]
    splits = steps(told.get("pre_tokenizer"), "pretokenizers")
    first = splits[0] if splits else {}
    kept = first.get("type") == "Split" and first.get("pattern", {}).get("Regex") == WORD_PARTS
    kept = kept and first.get("behavior") == "Removed" and first.get("invert") is True
    kept = kept and all(x["type"] == "ByteLevel" and not x["add_prefix_space"] for x in splits[1:])
    plain = [
        x["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase") or x["type"] == "Replace" and x["pattern"] == {"Regex": "\\s+"} and x["content"] == " "
        for x in steps(told.get("normalizer"), "normalizers")
    ]
    if not (told["model"]["type"] == "BPE" and kept and all(plain) and not told.get("decoder") and not told.get("post_processor")):
        raise ValueError("this tokenizer may join text over white space or decode otherwise: it cannot be used word by word")
    return told


class Encoder:
    """Tokens of whole words, remembered; one object per task."""

    def __init__(self, definition: str, remembered: int = REMEMBERED):
        told = checked(definition)
        self.remembered = remembered
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.tokens = [""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.tokens[i] = token
        #: Tokens that end a match of the pattern, if the definition marks them.
        suffix = told["model"].get("end_of_word_suffix")
        self.last = np.array([bool(suffix) and t.endswith(suffix) for t in self.tokens], dtype=bool)
        self.known: dict[bytes, tuple[bytes, str]] = {}

    def decode(self, ids: list[int]) -> str:
        """As the library does without a decoder: the tokens, special ones too, with spaces between them."""
        return " ".join([self.tokens[i] for i in ids])

    def _keep(self, words: list[bytes], ids: list[int], edges: list[int]) -> None:
        tokens, data = [self.tokens[i] for i in ids], np.array(ids, dtype="<u4").tobytes()
        start = 0
        for word, end in zip(words, edges, strict=True):
            self.known[word] = (data[4 * start : 4 * end], " ".join(tokens[start:end]))
            start = end

    def _learn_simple(self, words: list[bytes], texts: list[str]) -> bool:
        """Letters with a stop at most: the tokens that end a match tell where words end. False if they do not."""
        ids = self.tokenizer.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids
        ends = np.flatnonzero(self.last[ids]) + 1
        matches = np.cumsum([1 + (t[-1] in STOPS) for t in texts])
        if len(ends) != matches[-1]:
            return False
        self._keep(words, ids, ends[matches - 1].tolist())
        return True

    def _learn_plain(self, words: list[bytes], texts: list[str]) -> None:
        whole = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        starts = np.cumsum([len(t) + 1 for t in texts])
        self._keep(words, whole.ids, np.searchsorted(np.array([o[0] for o in whole.offsets], dtype=np.int64), starts).tolist())

    def learn(self, words: list[bytes]) -> None:
        simple, plain, others = ([], []), ([], []), []
        for word in words:
            text = word.decode("utf-8", "surrogatepass")
            if SIMPLE.match(text):
                kind = simple
            elif PLAIN.match(text) and "<|" not in text:
                kind = plain
            else:
                others.append((word, text))
                continue
            kind[0].append(word)
            kind[1].append(text)
        if simple[0] and not self._learn_simple(*simple):
            self._learn_plain(*simple)
        if plain[0]:
            self._learn_plain(*plain)
        for word, text in others:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            self.known[word] = (np.array(ids, dtype="<u4").tobytes(), self.decode(ids))

    def reserve(self, words: set[bytes]) -> None:
        """Know all these words; what was known before is forgotten if that is too much."""
        new = words.difference(self.known)
        if new and len(self.known) + len(new) > self.remembered:
            self.known.clear()
            new = words
        if new:
            self.learn(list(new))

    def words(self, words: list[bytes]) -> list[tuple[bytes, str]]:
        known = self.known
        if any(w not in known for w in words):
            self.reserve(set(words))
        return [known[w] for w in words]


def packed(chunk: bytes, encoder: Encoder) -> bytes:
    """A chunk's encoding: bytes up to its first white space, tokens of the words between, bytes after its last one.

    A chunk without white space is all head, marked by a tail of length 2**32 - 1.
    """
    first = SPACE.search(chunk)
    if first is None:
        return struct.pack("<II", len(chunk), 0xFFFFFFFF) + chunk
    words = chunk[first.start() :].split()
    tail = b"" if SPACE.match(chunk[-1:]) or not words else words.pop()
    ids = b"".join([x[0] for x in encoder.words(words)])
    return struct.pack("<II", first.start(), len(tail)) + chunk[: first.start()] + tail + ids


class Assembly:
    """Puts the tokens of one text together, chunk after chunk."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.ids, self.decoded, self.open = encoder, [], [], b""

    def add_words(self, words: list[bytes]) -> None:
        found = self.encoder.words(words)
        self.ids += [x[0] for x in found]
        self.decoded += [x[1] for x in found if x[0]]

    def add_text(self, chunk: bytes) -> None:
        chunk = self.open + chunk
        words = chunk.split()
        self.open = b"" if not words or SPACE.match(chunk[-1:]) else words.pop()
        self.add_words(words)

    def add_packed(self, data: bytes) -> None:
        head, tail = struct.unpack_from("<II", data)
        if tail == 0xFFFFFFFF:
            self.open += data[8:]
            return
        join = self.open + data[8 : 8 + head]
        if join:  # the word across the join, whole now
            self.add_words([join])
        ids = data[8 + head + tail :]
        self.ids.append(ids)
        if ids:
            self.decoded.append(self.encoder.decode(np.frombuffer(ids, dtype="<u4").tolist()))
        self.open = data[8 + head : 8 + head + tail]

    def result(self) -> tuple[int, str, str]:
        if self.open:
            self.add_words([self.open])
            self.open = b""
        ids = b"".join(self.ids)
        decoded = " ".join(self.decoded).encode("utf-8", "surrogatepass")
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


def shared_marks(texts: DataFrame) -> np.ndarray:
    """Bitmap of fixed size with the places of all chunks that occur more than once."""

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = pd.Series([name(c) for chunks in cuts(as_bytes(batch["text"])) for c in chunks], dtype=object)
            n = keys.value_counts()
            yield pd.DataFrame({"key": n.index, "n": n.to_numpy(), "at": [place(k) for k in n.index]})

    counted = texts.mapInPandas(names, "key binary, n long, at long").groupBy("key", "at").agg(F.sum("n").alias("n")).where("n > 1")
    marks = counted.groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("m"))
    bits = np.zeros((1 << MARK_BITS) // 8, dtype=np.uint8)
    for row in marks.collect():
        part = np.frombuffer(row["m"], dtype=np.uint8)
        bits[(row["b"] - 1) * (BUCKET // 8) :][: len(part)] = part
    return bits


def marked(bits: np.ndarray, key: bytes) -> bool:
    at = place(key)
    return bool(bits[at >> 3] >> (at & 7) & 1)


def encode(docs: DataFrame, tokenizer: str, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, for the tokenizer definition at that path.

    ``remembered`` words are kept per task; fewer take less memory and more time, with the same result.
    The definition (a file of a few MB, read by the driver) goes to the tasks as a broadcast; one that cannot be used word
    by word is an error (`checked`). Null texts count as
    empty ones and have no tokens; texts of any length are encoded whole; repeated rows give repeated results; an
    empty table gives none; other columns are not read.
    """
    spark = docs.sparkSession
    told = Path(tokenizer).read_text(encoding="utf-8")
    checked(told)
    definition = spark.sparkContext.broadcast(told)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bits = spark.sparkContext.broadcast(shared_marks(texts.select("text")))

    def shares(texts: pd.Series) -> pd.Series:
        return pd.Series([any(marked(bits.value, name(c)) for c in chunks) for chunks in cuts(as_bytes(texts))], dtype=bool)

    rows = texts.withColumn("fp", F.md5("text"))
    sharing = rows.where(F.pandas_udf(shares, "boolean")("text"))
    # Each text once; copies are dropped before the shuffle.
    sharing = stored(sharing.groupBy("fp").agg(F.first("text").alias("text")), "bpe-sharing")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            once = {name(c): c for chunks in cuts(as_bytes(batch["text"])) for c in chunks}
            found = [(k, c) for k, c in once.items() if marked(bits.value, k)]
            yield pd.DataFrame(found, columns=["key", "chunk"])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(definition.value, remembered)
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "data": [packed(c, encoder) for c in batch["chunk"]]})

    once = sharing.select("text").mapInPandas(pieces, "key binary, chunk binary").groupBy("key").agg(F.first("chunk").alias("chunk"))
    packs = stored(once.mapInPandas(pack, "key binary, data binary"), "bpe-chunks")

    def uses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                (fp, i, k)
                for fp, chunks in zip(batch["fp"], cuts(as_bytes(batch["text"])), strict=True)
                for i, k in enumerate(map(name, chunks))
                if marked(bits.value, k)
            ]
            yield pd.DataFrame(found, columns=["fp", "at", "key"])

    used = sharing.mapInPandas(uses, "fp string, at int, key binary").join(packs, "key")
    used = used.groupBy("fp").agg(F.array_sort(F.collect_list(F.struct("at", "data"))).alias("u"))
    used = used.select("fp", F.col("u.at").alias("at"), F.col("u.data").alias("data"))

    def assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(definition.value, remembered)
        for batch in batches:
            found = []
            for fp, chunks, at, data in zip(batch["fp"], cuts(as_bytes(batch["text"])), batch["at"], batch["data"], strict=True):
                known, text, own = dict(zip(at, data, strict=True)), Assembly(encoder), []
                for i, chunk in enumerate(chunks):
                    if i in known:
                        if own:
                            text.add_text(b"".join(own))
                            own = []
                        text.add_packed(known[i])
                    else:
                        own.append(chunk)
                if own:
                    text.add_text(b"".join(own))
                found.append((fp, *text.result()))
            yield pd.DataFrame(found, columns=["fp", "n", "i", "d"])

    # A row per different text with shared chunks.
    whole = sharing.join(used, "fp").mapInPandas(assemble, "fp string, n long, i string, d string")

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(definition.value, remembered)
        for batch in batches:
            raws = as_bytes(batch["text"])
            own = [not any(marked(bits.value, name(c)) for c in chunks) for chunks in cuts(raws)]
            split = [raw.split() if mine else None for raw, mine in zip(raws, own, strict=True)]
            encoder.reserve({word for words in split if words for word in words})
            found = []
            for words in split:
                if words is None:
                    found.append((None, None, None))
                    continue
                text = Assembly(encoder)
                text.add_words(words)
                found.append(text.result())
            out = pd.DataFrame(found, columns=["n_tokens", "ids_sha256", "decoded_sha256"], dtype=object)
            out["n_tokens"] = out["n_tokens"].astype("Int64")
            yield pd.concat([batch[["doc_id", "fp"]].reset_index(drop=True), out], axis=1)

    out = rows.mapInPandas(alone, "doc_id long, fp string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    out = out.join(whole, "fp", "left")
    return out.select(
        "doc_id",
        F.coalesce("n_tokens", "n").alias("n_tokens"),
        F.coalesce("ids_sha256", "i").alias("ids_sha256"),
        F.coalesce("decoded_sha256", "d").alias("decoded_sha256"),
    )
