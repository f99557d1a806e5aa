"""The few kernels that Spark lacks, as Arrow UDFs over whole batches."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal
from urllib.parse import quote

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KANJI_DIGITS = {c: i for i, c in enumerate("〇一二三四五六七八九")}
_KANJI_NUMBER = re.compile("([〇一二三四五六七八九十百]+)(?=丁目|番地?|号)")
_PREFECTURE = re.compile("^(?:東京都|北海道|京都府|大阪府|[一-龠]{2,3}県)")


@F.arrow_udf(T.StringType())
def nfkc(values: pa.Array) -> pa.Array:
    """Unicode NFKC, by Python's tables: Arrow's own kernel leaves some kana decomposed."""
    return pa.array([v if v is None or v.isascii() else unicodedata.normalize("NFKC", v) for v in values.to_pylist()], pa.string())


def kanji_number(chunk: str) -> str:
    """A run of numerals as a decimal number; NaN if a place holds more than one digit."""
    total, rest = 0, chunk
    for unit, worth in (("百", 100), ("十", 10)):
        head, found, tail = rest.partition(unit)
        if found:
            times = _KANJI_DIGITS.get(head) if head else 1
            if times is None:
                return "NaN"
            total += times * worth
            rest = tail.partition(unit)[0]
    if rest:
        if rest not in _KANJI_DIGITS:
            return "NaN"
        total += _KANJI_DIGITS[rest]
    return str(total)


def address_text(value: str, strip_prefecture: bool) -> str:
    text = unicodedata.normalize("NFKC", value)
    if strip_prefecture:
        text = _PREFECTURE.sub("", text)
    return _KANJI_NUMBER.sub(lambda m: kanji_number(m[1]), text)


def address_kernel(col: Column, strip_prefecture: bool = False) -> Column:
    """NFKC, the prefecture if it's to go, and numerals before block marks as digits: one pass."""

    @F.arrow_udf(T.StringType())
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else address_text(v, strip_prefecture) for v in values.to_pylist()], pa.string())

    return run(col)


def _units(s: str):
    """UTF-16 code units: the string itself unless it goes beyond the BMP."""
    return s if not s or ord(max(s)) <= 0xFFFF else np.frombuffer(s.encode("utf-16-le"), "<u2").tolist()


def jaro(a, b) -> float:
    """Jaro similarity with half transpositions; matches are taken greedily from the left of a."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(n, m) // 2 - 1
    free, letters = list(b), set(b)
    taken = []
    for i, c in enumerate(a):
        if c in letters:
            try:  # list.index looks through the window in C
                free[free.index(c, max(0, i - reach), max(0, i + reach + 1))] = None
            except ValueError:
                continue
            taken.append(c)
    k = len(taken)
    if not k:
        return 0.0
    others = [c for c, f in zip(b, free) if f is None]
    odd = sum(x != y for x, y in zip(taken, others)) / 2
    return (k / n + k / m + (k - odd) / k) / 3


def jaro_winkler(a: str, b: str) -> float:
    a, b = _units(a), _units(b)
    j = jaro(a, b)
    if j <= 0.7:
        return j
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return j + prefix * 0.1 * (1 - j)


#: Pairs that a worker remembers from batch to batch: names repeat far more often than they are new.
_REMEMBERED = 1 << 18
_known_pairs: dict[tuple[str, str], float] = {}


def _remembered(pair: tuple[str, str]) -> float:
    known = _known_pairs.get(pair)
    if known is None:
        if len(_known_pairs) >= _REMEMBERED:
            _known_pairs.clear()
        known = _known_pairs[pair] = jaro_winkler(*pair)
    return known


@F.arrow_udf(T.DoubleType())
def jaro_winkler_udf(left: pa.Array, right: pa.Array) -> pa.Array:
    """Null if either side is; a worker computes equal pairs once, as long as it remembers them."""
    return pa.array([None if None in pair else _remembered(pair) for pair in zip(left.to_pylist(), right.to_pylist())], pa.float64())


def fixed(x: float, digits: int) -> str:
    """The exact binary value, rounded half up, away from zero."""
    return str(Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def to_fixed(col: Column, digits: int) -> Column:
    """x with that many decimals, as text; null stays null. Rounds the binary value, not its shortest decimal form."""

    @F.arrow_udf(T.StringType())
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None or not math.isfinite(v) else fixed(v, digits) for v in values.to_pylist()], pa.string())

    return run(col)


# --- URLs that the native path doesn't cover ------------------------------------------------------------------------
_DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}


def _host(host: str) -> str:
    if host.isascii():
        return host.lower()
    return unicodedata.normalize("NFKC", host).lower().encode("idna").decode()


def _segments(path: str) -> str:
    out: list[str] = []
    parts = path.replace("\\", "/").split("/")[1:]
    for i, part in enumerate(parts):
        plain = part.lower().replace("%2e", ".")
        last = i == len(parts) - 1
        if plain == "..":
            out = out[:-1]
        if plain in (".", ".."):
            if last:
                out.append("")
            continue
        out.append(part)
    return "/" + "/".join(quote(p, safe="!$%&'()*+,-./:;=@[]_~|^\\") for p in out)


def web_url(value: str) -> str:
    """Scheme, host and path of a URL, without user, default port, query, fragment and one last slash.

    What isn't a URL comes back trimmed, without one last slash, in lower case.
    """
    text = value.strip()
    plain = (text[:-1] if text.endswith("/") else text).lower()
    m = re.match(r"([A-Za-z][A-Za-z0-9+.\-]*):(.*)\Z", re.sub("[\t\r\n]", "", text), re.S)
    if not m:
        return plain
    scheme, rest = m[1].lower(), re.split(r"[?#]", m[2], maxsplit=1)[0]
    if scheme not in _DEFAULT_PORTS:
        if rest.startswith("//"):
            host, slash, path = rest[2:].partition("/")
            host = host.rpartition("@")[2]
            path = _segments(slash + path) if slash else ""
        else:
            host, path = "", rest
        return f"{scheme}://{host.lower()}{path.removesuffix('/')}"
    rest = rest.replace("\\", "/").lstrip("/")
    host, slash, path = rest.partition("/")
    host, _, port = host.rpartition("@")[2].partition(":") if "[" not in host else (host.rpartition("@")[2], "", "")
    try:
        host = _host(host)
    except UnicodeError:
        return plain
    if not host or re.search(r"[\s<>^|%\[\]]", host.strip("[]")) or port and not (port.isascii() and port.isdigit() and int(port) < 65536):
        return plain
    port = "" if port in ("", _DEFAULT_PORTS[scheme]) else f":{int(port)}"
    return f"{scheme}://{host}{port}{_segments(slash + path if slash else '/').removesuffix('/')}"


@F.arrow_udf(T.StringType())
def web_url_udf(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else web_url(v) for v in values.to_pylist()], pa.string())


# --- Charset of uploads ---------------------------------------------------------------------------------------------
SNIFFED = 1024


#: What a decoder meets, in order of preference: a Shift_JIS pair (with a two-byte UTF-8 pair right behind it, which is
#: then counted too), a two-byte UTF-8 pair, or any byte. Three-byte UTF-8 looks like Shift_JIS; that is the source's rule.
_PAIRS = re.compile(rb"(?P<sjis>[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc])(?P<next>[\xc0-\xdf][\x80-\xbf])?|(?P<utf8>[\xc0-\xdf][\x80-\xbf])|[\x00-\xff]")
_MARKS = {b"\xef\xbb\xbf": "utf-8", b"\xff\xfe": "utf-16le"}


def sniff_charset(head: bytes) -> str:
    """utf-8 or utf-16le by their marks; else shift_jis if its byte pairs outnumber two-byte UTF-8 and are over two."""
    for mark, charset in _MARKS.items():
        if head.startswith(mark):
            return charset
    found = Counter(kind for m in _PAIRS.finditer(head[:SNIFFED]) for kind in ("sjis", "next", "utf8") if m[kind])
    return "shift_jis" if found["sjis"] > max(2, found["next"] + found["utf8"]) else "utf-8"


# --- Brands ---------------------------------------------------------------------------------------------------------
class BrandMatcher:
    """Exact, then partial, then similar matches of a name with an ordered list of normalised brands."""

    def __init__(self, brands: list[str], generic: frozenset[str], threshold: float):
        self.threshold = threshold
        self.brands = brands
        self.place = {b: i for i, b in enumerate(brands)}
        open_brands = [(i, b) for i, b in enumerate(brands) if b not in generic]
        self.inside = ahocorasick.Automaton()
        self.around: dict[str, int] = {}
        for i, b in open_brands:
            if len(b) >= 3:
                self.inside.add_word(b, i)
            for n in range(4, len(b) + 1):
                for k in range(len(b) - n + 1):
                    self.around.setdefault(b[k : k + n], i)
        self.inside.make_automaton()
        self.open = open_brands
        self.letters = {c: k for k, c in enumerate(sorted({c for _, b in open_brands for c in b}))}
        self.counts = np.zeros((len(self.letters) or 1, len(open_brands)), np.int16)
        for k, (_, b) in enumerate(open_brands):
            for c, n in Counter(b).items():
                self.counts[self.letters[c], k] = n
        self.sizes = np.array([len(b) for _, b in open_brands], float)

    def __call__(self, name: str) -> tuple[str, str | None, float]:
        """Kind of match, brand, and the best similarity if it was looked for."""
        if name in self.place:
            return "exact", name, 0.0
        hits = [i for _, i in self.inside.iter(name)] if len(self.inside) else []
        if len(name) >= 4 and name in self.around:
            hits.append(self.around[name])
        if hits:
            return "partial", self.brands[min(hits)], 0.0
        best, which = self._similar(name)
        return ("similar", which, best) if which is not None and best >= self.threshold else ("none", None, best)

    def _similar(self, name: str) -> tuple[float, str | None]:
        """The greatest similarity and its first brand; a bound by common letters leaves out most brands."""
        both = np.zeros(len(self.open), float)
        for c, n in Counter(name).items():
            if c in self.letters:
                both += np.minimum(self.counts[self.letters[c]], n)
        with np.errstate(divide="ignore", invalid="ignore"):
            bound = np.where(both > 0, (both / len(name) + both / self.sizes + 1) / 3, 0.0)
        bound = np.where(bound > 0.7, bound + 0.4 * (1 - bound), bound) + 1e-9
        best, at = 0.0, -1
        for k in np.argsort(-bound, kind="stable"):
            if bound[k] < best or both[k] == 0:
                break
            s = jaro_winkler(name, self.open[k][1])
            if s > best or s == best and 0 <= k < at:
                best, at = s, int(k)
        return best, self.open[at][1] if at >= 0 else None


MATCH = T.StructType([T.StructField("kind", T.StringType()), T.StructField("brand", T.StringType()), T.StructField("similarity", T.DoubleType())])


def match_brands(name: Column, matcher_broadcast) -> Column:
    """struct<kind, brand, similarity> of a normalised name."""

    @F.arrow_udf(MATCH)
    def run(values: pa.Array) -> pa.Array:
        matcher = matcher_broadcast.value
        found = [matcher(v) if v else ("none", None, 0.0) for v in values.to_pylist()]
        kinds, brands, sims = (list(x) for x in zip(*found)) if found else ([], [], [])
        return pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(brands, pa.string()), pa.array(sims, pa.float64())], names=["kind", "brand", "similarity"])

    return run(name)
