"""Secret scan: base patterns, and dictionary-primed zstandard novelty for strings in a sensitive context.

A candidate is a long string without spaces that follows a telling word closely; the word may be part of a name, as in
``SECRET_KEY`` or ``apiKeyProd``.  Its novelty is what it adds to the compressed size of its surroundings: the text
around it is compressed with and without it, both primed with a dictionary.  The same is done with its words apart and
in small letters, as an identifier is a row of known words, and the lesser counts.  The bytes are set against what random
strings of its length over its own alphabet add in its place.  Words, identifiers, paths and repeats of the surroundings
add less; random keys, hex or not, add as much.  Candidates of high novelty that overlap no base span are reported as
``novel``, with the bytes they add a character.

The dictionary holds words of program code and the most frequent words of all documents (``Vocabulary``); a word counts
only if at least ``LEAST_TEXTS`` different texts hold it, so that no secret gets in through copies.  Every eighth of these
words is left out of it; identifiers made of words, some of them left out, calibrate the novelty that is asked for.

Base spans are found by the contract's patterns on whole texts and always stay.

Defined cases: a null or empty text has no spans; repeated documents are scanned one by one; other columns are
carried through; an empty table gives no rows.  Offsets are code points.
"""

from __future__ import annotations

import random
import re
import string
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.llm.common import map_text, table

#: Kinds of spans, in the order of ties.
KINDS = ("assign", "access", "hex", "novel")

# The contract's patterns.
_ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")

#: Telling words of candidates, and how far behind them a candidate may start.
_SENSITIVE = re.compile(r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|auth[a-z]*|bearer|credential|(?:private|access|encryption|signing)[_-]?key|signature)s?(?-i:(?![a-z]))(?:[A-Za-z0-9_-]{0,32}[\"']?\x20*[:=]>?)?", re.IGNORECASE | re.ASCII)
_SENSITIVE_WORDS = (b"pass", b"pwd", b"secret", b"token", b"api", b"auth", b"bearer", b"credential", b"private", b"access", b"encryption", b"signing", b"signature")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~!@#$%^&*.-]{16,}")
_SHORTEST = 16
REACH = 40
#: Code points of the surroundings on either side.
AROUND = 256
#: Share of the compressed bytes of random strings over its own alphabet that a candidate must add: where identifiers
#: calibrate it, between these bounds.
NOVELTY = 0.8
NOVELTY_BOUNDS = (0.78, 0.95)
#: Share of made-up identifiers that may pass, and their number.
PASSING = 0.01
MADE_UP = 400
#: Words of the corpus in the dictionary, their letters, and how many different texts must hold each.
CORPUS_WORDS = 4096
LEAST_TEXTS = 8
_WORD = "[a-z]{3,16}"
#: Bytes a character that it must add at least: below random digits (0.42), above runs of one sign.
LEAST = 0.35
#: Random strings that a candidate is set against.
DRAWS = 4
_CLASSES = (string.digits, string.ascii_lowercase, string.ascii_uppercase)
_HEXES = ("0123456789abcdef", "0123456789ABCDEF")

#: Words of program code that are not secrets; fixed values.
CODE_WORDS = (
    "password passwd secret token api key apikey access private public authorization auth bearer credentials signature username email address phone city description parameter arguments return import package version config configuration settings options "
    "default example sample test localhost http https www com org net json xml content type agent placeholder changeme your here base "
    "sha md5 uuid hash digest put add new old element document listener event prototype constructor undefined interface "
    "implements extends protected static class function method list map array object index count size length string number int bool true "
    "false null none file path folder url host port server client request response header body code encode decode read write open close "
    "start stop init load save update delete create find search filter sort order group page item node tree table column row field record "
    "message queue task job worker thread service manager handler factory builder provider context session cookie cache store state status "
    "error exception log debug info time date day year total average max min first last next parent child root data model view route query "
    "set get user name by id value"
).split()
PLAIN = b"application/json abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000 11111111 xxxxxxxx ********"
#: Stands before all surroundings, so that short ones have the compressor's tables, too.
PREAMBLE = "the user name and password of this server are read from the config file, see the example for a token 2024-01-31 12:59:07 v1.8\n"
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+")

_SPANS = T.StructType(
    [
        T.StructField(
            "spans",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("kind", T.IntegerType()),
                        T.StructField("start", T.LongType()),
                        T.StructField("end", T.LongType()),
                        T.StructField("novelty", T.DoubleType()),
                    ]
                )
            ),
        )
    ]
)


def alphabet(candidate: str) -> str:
    """The characters of its classes: hex digits, or digits, small and capital letters as they occur, and its signs."""
    own = set(candidate)
    for hexes in _HEXES:
        if own <= set(hexes):
            return string.digits if own <= set(string.digits) else hexes
    known = "".join(c for c in _CLASSES if own & set(c))
    return known + "".join(sorted(own - set(known)))


def folded(candidate: str) -> str:
    """The words of an identifier in small letters, with spaces around them."""
    return f" {' '.join(x.lower() for x in _PARTS.findall(candidate) if x != '_')} "


@dataclass(frozen=True)
class Vocabulary:
    """Words of the dictionary, frequent ones first, words left out of it, and the novelty that a secret must reach."""

    words: tuple[str, ...] = ()
    left_out: tuple[str, ...] = ()
    novelty: float = NOVELTY

    def calibrated(self) -> Vocabulary:
        """The same words with the novelty that all but a share ``PASSING`` of made-up identifiers stay below."""
        scanner, scores, rng = Scanner(self), [], random.Random(17)
        known, unknown = [*CODE_WORDS, *self.words], self.left_out or CODE_WORDS
        while len(scores) < MADE_UP:
            words = [rng.choice(unknown if rng.random() < 0.25 else known) for _ in range(rng.randint(2, 5))]
            styles = ("_".join(words), "".join(w.title() for w in words), words[0] + "".join(w.title() for w in words[1:]), "-".join(words))
            name = rng.choice(styles) + rng.choice(("", "", str(rng.randint(0, 99))))
            if len(name) >= _SHORTEST:
                scores.append(scanner.score("an access token of ", name, " for the server")[0])
        passing = sorted(scores)[int((1 - PASSING) * MADE_UP)]
        return replace(self, novelty=min(max(passing + 0.01, NOVELTY_BOUNDS[0]), NOVELTY_BOUNDS[1]))


class Scanner:
    """Finds the secrets of one text after the other; holds the primed compressors."""

    def __init__(self, vocabulary: Vocabulary = Vocabulary()):
        import zstandard

        def primed(text: bytes):
            held = zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            return zstandard.ZstdCompressor(level=9, dict_data=held, write_content_size=False, write_checksum=False)

        words = [*reversed(vocabulary.words), *CODE_WORDS]  # what is nearest to the end costs least
        small = f" {' '.join(words)} ".encode()
        self.folding = primed(small)
        self.compressor = primed(PLAIN + b" " + " ".join(w.title() for w in words).encode() + small)
        self.novelty = vocabulary.novelty

    @staticmethod
    def _more(compressor, around: str, own: str) -> int:
        before = around.encode("utf-8", "replace")
        return len(compressor.compress(before + own.encode("utf-8", "replace"))) - len(compressor.compress(before))

    def added_bytes(self, before: str, candidate: str, after: str) -> int:
        """Compressed bytes that the candidate adds to its surroundings, as it is or with its words apart."""
        around = PREAMBLE + after + "\n" + before
        return min(self._more(self.compressor, around, candidate), self._more(self.folding, around.lower(), folded(candidate)))

    def score(self, before: str, candidate: str, after: str) -> tuple[float, int]:
        """Share of the bytes of random strings over its alphabet that the candidate adds, and these bytes."""
        added = self.added_bytes(before, candidate, after)
        rng = random.Random(candidate)
        drawn = ["".join(rng.choices(alphabet(candidate), k=len(candidate))) for _ in range(DRAWS)]
        return added * DRAWS / max(1, sum(self.added_bytes(before, x, after) for x in drawn)), added

    def base(self, text: str, low: bytes) -> list[tuple[int, int, int]]:
        """Start, kind and end of the base spans."""
        found = []
        if any(w in low for w in _WORDS):
            found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 12]
        if b"akia" in low:
            found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
        return sorted(found)

    def novel(self, text: str, low: bytes, base: list[tuple[int, int, int]]) -> list[tuple[int, int, float]]:
        """Start, end and novelty of further strings in a sensitive context."""
        if not any(w in low for w in _SENSITIVE_WORDS):
            return []
        found, done = [], 0
        for word in _SENSITIVE.finditer(text):
            at, reach = max(done, word.end()), word.end() + REACH
            while at <= reach and (near := _CANDIDATE.search(text, at, reach + _SHORTEST)):
                a, b = _CANDIDATE.match(text, near.start()).span()
                at = done = b
                own = text[a:b]
                if any(s < b and a < e for s, _, e in base):
                    continue
                before, after = text[max(0, a - AROUND) : a], text[b : b + AROUND]
                share, added = self.score(before, own, after)
                if added >= LEAST * len(own) and share >= self.novelty:
                    found.append((a, b, added / len(own)))
        return found

    def scan(self, raw: bytes | None) -> list[dict]:
        """All spans of a text by start, then kind."""
        if not raw:
            return []
        text, low = raw.decode("utf-8", "replace"), raw.lower()
        base = self.base(text, low)
        every = [(a, k, b, None) for a, k, b in base] + [(a, 3, b, n) for a, b, n in self.novel(text, low, base)]
        return [{"kind": k, "start": a, "end": b, "novelty": n} for a, k, b, n in sorted(every, key=lambda s: s[:3])]


def vocabulary(docs: DataFrame, text_col: str = "text") -> Vocabulary:
    """The most frequent words of all documents, and a calibrated novelty; at most ``CORPUS_WORDS`` reach the driver.

    How many different texts hold a word is told by a bitmap of 64 classes of texts.
    """
    text = F.col(f"`{text_col}`").cast("string")
    words = docs.select(F.xxhash64(text).alias("h"), F.explode(F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n"), F.expr("bit_or(shiftleft(1L, cast(pmod(h, 64) AS int)))").alias("texts"))
    common = counted.where(F.bit_count("texts") >= LEAST_TEXTS).orderBy(F.desc("n"), "word").limit(CORPUS_WORDS).select("word").collect()
    found = [r["word"] for r in common]
    return Vocabulary(tuple(w for i, w in enumerate(found) if i % 8 != 7), tuple(found[7::8])).calibrated()


def annotate(docs: DataFrame, text_col: str = "text", known: Vocabulary = Vocabulary(), out: str = "secrets", carry: list[str] | None = None) -> DataFrame:
    """Documents with a struct column: kind, start, end and novelty of every span."""

    def make():
        scanner = Scanner(known)
        return lambda texts: [{"spans": scanner.scan(t)} for t in texts]

    return map_text(docs, text_col, make, _SPANS, out, carry, binary=True)


def _named(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    docs = table(spark, sf_dir, "documents")
    found = annotate(docs, known=vocabulary(docs), carry=["doc_id"]).select("doc_id", F.col("secrets.spans").alias("s"))

    def number(kind: int) -> Column:
        return F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    base = F.filter("s", lambda x: x["kind"] < 3)
    return found.select(
        "doc_id",
        *[number(k) for k in range(3)],
        F.sha2(_named(base).cast("binary"), 256).alias("base_sha256"),
        _named(F.col("s")).alias("spans"),
    )
