"""Text that was decoded with the wrong character encoding: find it, and restore it where possible.

Texts are looked at word by word (a word is what stands between blanks), and every different word once, however many
texts hold it. A first pass counts in how many texts each word beyond ASCII occurs, and from that how common each
character trigram is, in a count-min sketch of fixed size; words that read as UTF-8 are left out, so a wrong decoding
does not become usual by being common. The cost of a text is how surprising its trigrams are. For every surprising word a
best-first search goes over encode, decode and unescape operations, always from the cheapest text reached so far, never
twice from the same one, until no text left can be cheaper, and keeps the cheapest. A passage is garbled if a text reached
over at least one decoding is clearly cheaper, or if even the cheapest holds traces of a decoding that lost bytes. The
words found are then looked up in the texts; only texts that hold one are put together again.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import html
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenix.operators.skew import salted_lookup, spread
from provenix.session import cut, shared_table

#: Counters in each of the two rows of the trigram sketch: a byte each in every task, so 8 MB.
BUCKETS = 1 << 22
#: How much cheaper a restored passage must be, in nats, and what an operation costs.
GAIN, STEP = 4.0, 0.5
#: The same in a text in which the same operations have restored another passage.
GAIN_AGAIN = 1.5
#: Mean surprise of a passage's trigrams from which it is searched.
ODD = 4.5
#: Share of all texts below which a trigram counts as unheard of, so surprise does not grow with the number of texts.
RARE = 5e-5
#: Bits of the filter of words found, per word and at most (16 MB). It only saves work: what it lets through is looked up.
WORD_BITS, MOST_BITS = 16, 1 << 27
#: Characters whose costs are worked out at a time.
_CHARS = 1 << 20

# Encodings in which text is stored, and those it is mistaken for.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp852", "cp866", "koi8-r", "iso8859-2", "iso8859-7", "cp1254", "cp1253", "gb18030", "cp932", "euc_kr", "euc_jp", "big5")
STORED_AS = ("utf-8", "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "mac_roman", "cp437", "cp850", "cp852", "cp866", "koi8-r", "iso8859-2", "iso8859-5", "gb18030", "cp932", "euc_jp", "big5", "euc_kr")
#: Of those it is mistaken for, the ones with several bytes to a character.
WIDE = ("gb18030", "cp932", "euc_kr", "euc_jp", "big5")
#: And those in which no common word of any language reads as UTF-8, as its second bytes are mostly signs.
CLEAR = ("cp1252", "latin-1", "cp1254", "cp1250", "cp1251", "iso8859-2", "cp437", "koi8-r", *WIDE)
# End of fixed values.

_ENTITY = re.compile(r"&(#\d{2,6}|#[xX][0-9a-fA-F]{2,5}|[A-Za-z]{2,8}\d?);")
_ODD_CHAR = re.compile(r"[^\x00-\x7f]")
_LOST = re.compile("�|ï¿½")
_C1 = re.compile("[\x80-\x9f]")
_LOWERED = re.compile("([à-ô])([\u0080-¿ÿŒœŠšŸŽžƒˆ˜–-›€™])")
_PARTS = re.compile("[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\uff00-\uffef]+|[^\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\uff00-\uffef]+")
_WIDE = re.compile("[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\uff00-\uffef]")
_USUAL = re.compile("[\x00-\x7f\xa1-\u017f\u0391-\u03c9\u0401-\u045f\u05d0-\u05ea\u0621-\u064a\u0900-\u097f\u0e01-\u0e4e\u2010-\u2044\u20ac\u2122\u3001-\u30ff\u4e00-\u9fff\uac00-\ud7af\uff01-\uff9f]+")
_NOT_ASCII = re.compile("[^\x00-\x7f\ufffd]+")
_SENTENCES = re.compile("[^。！？]*[。！？]|[^。！？]+")
_BLANK = r" \t\r\n\f\x0b"
_SPACES = re.compile(f"([{_BLANK}]+)")
#: A word with a character beyond ASCII or a character reference; the JVM and Python read it alike.
WORD = rf"(?<![^{_BLANK}])(?=[^{_BLANK}]*(?:[^\x00-\x7f]|&#?[A-Za-z0-9]{{2,9}};))[^{_BLANK}]+"
_WORD = re.compile(WORD)
#: Well-formed UTF-8 of characters beyond ASCII, with bytes as characters, from the first to the last of a stretch.
_UTF8 = "(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})"
_STRETCH = re.compile(f"{_UTF8}(?:[\\x00-\\x7f]*{_UTF8})*")
#: Marks that lean on the letters beside them and never stand alone between blanks, and what else may surround a sign.
_LEANING, _AROUND = "'\"‘’‚‛“”„‟", "'\"‘’‚‛“”„‟«»‹›()[].,;:!?"
_ALONE = re.compile("[\"'“‘«(]*(�|ï¿½|[\x80-ÿ])[\"'”’»),.;:]*")
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@functools.cache
def _bad() -> np.ndarray:
    """Extra cost of each code point: control, private, unassigned and replacement characters."""
    out = np.zeros(0x110000, "f4")
    out[[*range(0x20), *range(0x80, 0xA0), 0xFFFD]] = 8.0
    out[[c for c in range(0xA0, 0x110000) if unicodedata.category(chr(c)) in ("Co", "Cn", "Cs")]] = 8.0
    return out


class _Bytes(dict):
    """Byte of each character beyond ASCII, for str.translate; what has none becomes a character that no byte is."""

    def __missing__(self, c: int) -> int:
        return c if c < 128 else 0x100


@functools.cache
def _bytes_of(encoding: str) -> dict[int, int]:
    """The bytes of an encoding with a byte to a character; a byte it leaves open is that of the control character."""
    read = {b: codecs.decode(bytes([b]), encoding, "replace") for b in range(128, 256)}
    return _Bytes({b if c == "�" else ord(c): b for b, c in read.items() if c != "�" or b < 0xA0})


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket in the first row, bucket in the second) of every trigram with a character beyond ASCII; and the extra cost of each text.

    Blanks are put around each text; digits are all alike.
    """
    a = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    size = np.fromiter((len(t) + 2 for t in texts), "i8", len(texts))
    which = np.repeat(np.arange(len(texts)), size)
    extra = np.bincount(which, weights=_bad()[a], minlength=len(texts))
    if len(a) < 3:
        return np.empty(0, "i8"), np.empty((2, 0), "i8"), extra
    a = np.where((a >= 48) & (a <= 57), 48, a).astype("u8")
    odd = a > 127
    at = np.flatnonzero((odd[:-2] | odd[1:-1] | odd[2:]) & (which[:-2] == which[2:]))
    h = a[at] * _K1 ^ (a[at + 1] * _K2) << np.uint64(1) ^ a[at + 2] * _K3
    h = (h ^ (h >> np.uint64(29))) * _K2
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    return which[at], np.stack([h >> shift, ((h ^ (h >> np.uint64(32))) * _K3 >> shift) + np.uint64(BUCKETS)]).astype("i8"), extra


def words(documents: DataFrame) -> DataFrame:
    """(word, n): in how many different texts each word beyond ASCII or with a character reference occurs; ("", all texts that have one).

    Texts are told apart by their MD5, so only these words are shuffled, not the texts.
    """
    found = documents.where("text is not null").select(F.md5("text").alias("h"), F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("w"))
    one = found.where(F.size("w") > 0).dropDuplicates(["h"])
    return one.select(F.explode(F.array_append("w", F.lit(""))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def surprises(counted: DataFrame) -> np.ndarray:
    """Surprise of each bucket of the sketch in sixteenths of a nat; at most 2 * BUCKETS counts come to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some, n = b.column(0).to_pylist(), np.asarray(b.column(1))
            keep = [i for i, w in enumerate(some) if w and not suspect(w)]
            for i in range(0, len(keep), 4096):
                part = keep[i:i + 4096]
                which, bucket, _ = _grams([some[k] for k in part])
                pair = np.unique(np.r_[which, which] * (2 * BUCKETS) + bucket.ravel())  # a word counts once for each of its trigrams
                at, back = np.unique(pair % (2 * BUCKETS), return_inverse=True)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.bincount(back, weights=n[part][pair // (2 * BUCKETS)]).astype("i8"))], ["bucket", "n"])

    texts = counted.where("word = ''").select("n").head()
    texts = texts["n"] if texts else 0
    got = counted.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(2 * BUCKETS, "f4")
    table[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return np.clip(np.rint(np.log((texts + 20) / (table + 0.5 + RARE * texts)) * 16), 0, 255).astype("u1")


def reads_as_utf8(passage: str, encodings: tuple[str, ...]) -> bool:
    """Whether the bytes of the passage in one of the encodings are UTF-8 with characters beyond ASCII."""
    for e in encodings:
        try:
            if passage.encode(e).decode("utf-8") != passage:
                return True
        except UnicodeError:
            pass
    return False


def suspect(passage: str) -> bool:
    """Whether the passage is searched however common it is, and not counted among right texts.

    In the encodings that are not clear a word may read as a letter or two of UTF-8 by chance, but not as four.
    """
    wide = len(passage) > 1 and _WIDE.search(passage)
    for e in READ_AS:
        if e in WIDE and not wide:
            continue
        try:
            out = (passage.encode(e) if e in WIDE else sloppy(passage, e)).decode("utf-8")
        except UnicodeError:
            continue
        if out != passage and not _USUAL.sub("", out) and (e in CLEAR or sum(c > "\x7f" for c in out) >= 4):
            return True
    return False


def sloppy(text: str, encoding: str = "cp1252") -> bytes:
    """Bytes of an encoding with a byte to a character, in which those it leaves open pass as control characters."""
    return text.translate(_bytes_of(encoding)).encode("latin-1")


def passages(word: str) -> list[str]:
    """The parts of a text without blanks that are searched one by one.

    Scripts without spaces run into their neighbours, so they are parted from these; what was read as such a script
    stays whole with the signs that came of it.
    """
    out, at = [], 0
    for run in _NOT_ASCII.finditer(word) if _WIDE.search(word) else ():
        start = run.start()
        for part in [run[0]] if reads_as_utf8(run[0], WIDE) else _SENTENCES.findall(run[0]):
            if _WIDE.search(part) and reads_as_utf8(part, WIDE):
                out += [*_PARTS.findall(word[at:start]), part]
                at = start + len(part)
            start += len(part)
    return [*out, *_PARTS.findall(word[at:])]


def stretches(passage: str) -> set[tuple[int, int]]:
    """(start, end) of every part that reads as UTF-8 in one of the encodings with a byte to a character, if not the whole."""
    out = set()
    for e in READ_AS:
        if e not in WIDE:
            out |= {m.span() for m in _STRETCH.finditer(passage.translate(_bytes_of(e)))}
    return out - {(0, len(passage))}


def named(word: str, restored: str) -> bool:
    """Whether a sign is only named: one sign in quotes, or a mark alone that only stands beside letters."""
    if not restored.strip(_LEANING):
        return True
    bare = word.strip("()[].,;:!?")
    quoted = len(bare) > 2 and bare[0] in "\"'“‘„«‹" and bare[-1] in "\"'”’“»›"
    return quoted and len(restored.strip(_AROUND)) == 1


class Outcome(NamedTuple):
    """What the search found for one word: restored passages and their operations, the word searched whole, traces of lost bytes."""

    word: str
    fixed: str
    restored: int
    ways: list[str]
    again: str | None
    again_way: str | None
    lost: bool


OUTCOME = "word string, fixed string, restored int, ways array<string>, again string, again_way string, lost boolean"


class Restorer:
    """Searches words against the sketch of surprises."""

    def __init__(self, surprise: np.ndarray) -> None:
        self.surprise = surprise

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cost, mean, highest surprise) of each text as a whole."""
        cost, mean, top = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
        start = 0
        while start < len(texts):
            end, chars = start + 1, len(texts[start])
            while end < len(texts) and chars + len(texts[end]) < _CHARS:
                chars += len(texts[end])
                end += 1
            which, bucket, extra = _grams(texts[start:end])
            s = np.maximum(self.surprise[bucket[0]], self.surprise[bucket[1]]) / 16
            total, n = np.bincount(which, weights=s, minlength=end - start), np.bincount(which, minlength=end - start)
            cost[start:end], mean[start:end] = total + extra, total / np.maximum(n, 1)
            if len(which):
                first = np.flatnonzero(np.r_[True, np.diff(which) != 0])
                top[start + which[first]] = np.maximum.reduceat(s, first)
            start = end
        return cost, mean, top

    def odd(self, passage: str) -> bool:
        """Whether the passage is worth a search."""
        if _ENTITY.search(passage) or _C1.search(passage):
            return True
        _, mean, top = self.costs([passage])
        return bool(mean[0] > ODD or top[0] > ODD + 1.5)

    @staticmethod
    def moves(text: str) -> Iterator[tuple[str, str]]:
        """(operation, text) for every operation that applies."""
        if _ENTITY.search(text):
            yield "unescape", html.unescape(text)
        if _LOWERED.search(text):
            yield "recase", _LOWERED.sub(lambda m: m[1].upper() + m[2].replace("ÿ", "Ÿ"), text)
        met: set[bytes] = set()
        wide = _WIDE.search(text)
        for e in READ_AS:
            if e in WIDE and not wide:
                continue
            try:  # bytes that an encoding leaves open pass as control characters
                raw = text.encode(e) if e in WIDE else sloppy(text, e)
            except UnicodeEncodeError:
                continue
            if raw in met:
                continue
            met.add(raw)
            for d in STORED_AS:
                if d == e or (e in WIDE and d != "utf-8"):  # any two of these read as each other, so it would tell nothing
                    continue
                try:
                    out = raw.decode(d)
                except UnicodeDecodeError:
                    continue
                if out != text:
                    yield f"{e}>{d}", out

    def search(self, passage: str) -> tuple[str, float, tuple[str, ...]]:
        """(cheapest text reached, how much cheaper it is, operations to it).

        Unescaping, restoring letter case and decoding as UTF-8 lead on to further texts; every other decoding ends a
        way, and must make the passage less surprising per trigram too, as it may shorten it to a few unheard-of signs.
        The search goes on until every text left costs more by its operations alone than the best one found.
        """
        (start,), (mean,), _ = self.costs([html.unescape(passage)])  # references to characters are no better than the characters
        best = (passage, 0.0, ())
        heap: list[tuple[float, int, str, tuple[str, ...]]] = [(start, 0, passage, ())]
        visited, serial = {passage}, 0
        while heap:
            cost, _, text, path = heapq.heappop(heap)
            spent = STEP * (len(path) + 1)
            if start - best[1] <= spent:
                continue
            fresh = []
            for name, out in self.moves(text):
                prepares, utf8 = ">" not in name, name.endswith(">utf-8")
                if out in visited or (not (prepares or utf8) and any(">" in step for step in path)):
                    continue
                visited.add(out)
                fresh.append((name, out, prepares, utf8))
            if not fresh:
                continue
            reach, means, _ = self.costs([f[1] for f in fresh])
            for (name, out, prepares, utf8), reached, m in zip(fresh, reach + spent, means):
                serial += 1
                way = (*path, name)
                if not prepares and start - reached > best[1] and (utf8 or m < mean - 1):
                    best = (out, start - reached, way)
                if prepares or utf8:  # what only prepares must not look worse than it leads to
                    heapq.heappush(heap, (min(reached, cost) if prepares else reached, serial, out, way))
        return best

    def fix(self, run: str, found: tuple[str, float, tuple[str, ...]]) -> tuple[str, list[str]]:
        """(restored passage, operations of each restored part): whole, else in the stretches that read as UTF-8, cheapest first."""
        if found[1] >= GAIN:
            return found[0], [" ".join(found[2])]
        got = []
        for a, b in stretches(run):
            out, gain, way = self.search(run[a:b])
            if gain >= GAIN:
                got.append((-gain, a, b, out, " ".join(way)))
        taken: list[tuple] = []
        for g in sorted(got):
            if all(g[2] <= t[1] or g[1] >= t[2] for t in taken):
                taken.append(g)
        for _, a, b, out, _ in sorted(taken, key=lambda t: -t[1]):
            run = run[:a] + out + run[b:]
        return run, [t[4] for t in taken]

    def analyse(self, word: str) -> Outcome | None:
        """What can be said of a word without its text; None if nothing is wrong with it."""
        runs, ways, fixed = passages(word), [], word
        whole = self.search(word)
        if self.odd(word) or any(map(suspect, runs)):
            parts = []
            for run in runs:
                if len(runs) == 1 or self.odd(run) or suspect(run):
                    run, used = self.fix(run, whole if run == word else self.search(run))
                    ways += used
                parts.append(run)
            fixed = "".join(parts)
            if ways and named(word, fixed):
                fixed, ways = word, []
        if fixed != word:
            whole = self.search(fixed)
        again = whole[0] if whole[1] >= GAIN_AGAIN and not named(word, whole[0]) else None
        lost = bool(_LOST.search(fixed) or _C1.search(fixed))
        if not (ways or again or lost):
            return None
        return Outcome(word, fixed, len(ways), sorted(set(ways)), again, " ".join(whole[2]) if again else None, lost)


def assemble(text: str, known: dict[str, Outcome]) -> tuple[str, int, int, str]:
    """(restored text, passages restored, passages beyond restoring, operations used) of a text, given what is known of its words."""
    parts = _SPACES.split(text)
    restored, lost, used = 0, 0, {}
    at = [(k, known[parts[k]]) for k in range(0, len(parts), 2) if parts[k] in known]
    for k, o in at:
        restored += o.restored
        used.update(dict.fromkeys(o.ways))
        parts[k] = o.fixed
    for k, o in at:  # what was done to one passage was likely done to its neighbours, so less speaks for it
        if o.again is not None and o.again_way in used:
            restored += 1
            parts[k] = o.again
    for k, o in at:
        if o.lost and (_LOST.search(parts[k]) or _C1.search(parts[k])) and not _shown(parts, k):
            lost += 1
    return "".join(parts), restored, lost, "; ".join(used)


def _shown(parts: list[str], k: int) -> bool:
    """Whether a sign is only named: it stands alone, quoted or in a list of such signs."""
    word = parts[k]
    if not _ALONE.fullmatch(word):
        return False
    if re.match("[\"'“‘«(]", word):
        return True
    near = [parts[i] for i in range(max(0, k - 4), min(len(parts), k + 5), 2) if i != k]
    return any(_ALONE.fullmatch(w) for w in near)


#: Bits of a word's hash that are passed over for each of its four places in the filter.
_PASSED = (0, 13, 26, 37)


def _places(word: str, bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)
    return [(h >> k) & (bits - 1) for k in _PASSED]


def word_filter(found: DataFrame) -> np.ndarray:
    """Bloom filter over the words found; its size follows their number up to MOST_BITS, packed by the executors."""
    n = found.count()
    bits = min(MOST_BITS, max(1 << 16, 1 << (WORD_BITS * max(n, 1) - 1).bit_length()))
    hashed = F.xxhash64("word")
    at = found.select(F.explode(F.array(*[F.shiftrightunsigned(hashed, k).bitwiseAND(F.lit(bits - 1)) for k in _PASSED])).alias("p"))
    got = at.groupBy(F.shiftright("p", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v")).toArrow()
    out = np.zeros(bits // 64, "i8")
    out[got["i"].to_numpy()] = got["v"].to_numpy()
    return np.unpackbits(out.view("u1"), bitorder="little")


def repairs(documents: DataFrame) -> DataFrame:
    """(doc_id, restored_text, n_restored, n_lost, operations) of every document with a wrongly decoded passage.

    ``restored_text`` is the text with every passage restored that can be; ``n_lost`` counts the passages whose bytes
    are gone. Null, empty and ASCII texts have no row (ASCII texts with character references are looked at), nor have
    rows without a doc_id; a document delivered twice has one row. Equal texts get equal answers. An entity alone is
    spelling, not a wrong decoding, and a sign that is only named (quoted, listed, or a mark alone that cannot stand
    alone) is no case.
    """
    spark = documents.sparkSession
    source = documents.select("doc_id", "text").where("doc_id is not null")
    counted = cut(words(source))
    surprise = spark.sparkContext.broadcast(surprises(counted))  # 8 MB

    def examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = Restorer(surprise.value)
        for b in batches:
            got = [o for w in b.column(0).to_pylist() if w and (o := engine.analyse(w))]
            yield pa.RecordBatch.from_pylist([o._asdict() for o in got], schema=kind)

    kind = pa.schema([("word", pa.string()), ("fixed", pa.string()), ("restored", pa.int32()), ("ways", pa.list_(pa.string())), ("again", pa.string()), ("again_way", pa.string()), ("lost", pa.bool_())])
    path = shared_table(spark, "words")
    spread(counted.select("word"), "word").mapInArrow(examine, OUTCOME).write.parquet(path)
    found = spark.read.schema(OUTCOME).parquet(path)
    bloom = word_filter(found)
    shared = spark.sparkContext.broadcast(np.packbits(bloom, bitorder="little"))  # at most MOST_BITS

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value, bitorder="little")
        met: dict[str, bool] = {}
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                hits = []
                for w in set(_WORD.findall(text)):
                    ok = met.get(w)
                    if ok is None:
                        ok = all(bits[p] for p in _places(w, len(bits)))
                        if len(met) < 100_000:
                            met[w] = ok
                    if ok:
                        hits.append(w)
                if hits:
                    out.append((doc, text, sorted(hits)))
            ids, texts, hits = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(hits, pa.list_(pa.string()))], ["doc_id", "text", "words"])

    odd = source.where(F.col("text").rlike(r"[^\x00-\x7f]|&#?\w+;")).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    hit = cut(odd.mapInArrow(probe, "doc_id bigint, text string, words array<string>").dropDuplicates(["doc_id"]))
    known = salted_lookup(hit.select("doc_id", F.explode("words").alias("word")), found, "word", how="inner")
    known = known.groupBy("doc_id").agg(F.collect_list(F.struct(*Outcome._fields)).alias("known"))  # different words of one text

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, text, all_known in zip(*(c.to_pylist() for c in b.columns)):
                fixed, restored, lost, used = assemble(text, {o["word"]: Outcome(**o) for o in all_known})
                if restored or lost:
                    out.append((doc, fixed, restored, lost, used))
            ids, fixed, restored, lost, used = zip(*out) if out else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fixed, pa.string()), pa.array(restored, pa.int32()), pa.array(lost, pa.int32()), pa.array(used, pa.string())],
                                             ["doc_id", "restored_text", "n_restored", "n_lost", "operations"])

    return hit.join(known, "doc_id").select("doc_id", "text", "known").mapInArrow(rebuild, "doc_id bigint, restored_text string, n_restored int, n_lost int, operations string")
