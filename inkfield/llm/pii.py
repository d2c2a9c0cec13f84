"""Operator 1: personal data by weak supervision.

Candidates are spans of four kinds: those of the base patterns (which always stay), what has a
base pattern's shape but fails its checks (parts over 255, digits that fail Luhn, too few or too
many digits after a plus sign, a domain without a dot), and looser forms that the base leaves out
(addresses that are spelled out, bracketed or spaced; IPv6; quads with bracketed or spelled dots;
phone numbers without a plus sign). Four labelers vote for, against or abstain on every candidate:

* pattern: for the strict form, against what fails its checks, abstaining on looser forms;
* gazetteer: known top-level domains, card issuers, country codes, address ranges;
* context: whole words just before it that announce, or rule out, the kind; without any, for what
  stands in prose and against what stands among other numbers;
* edges: for a clean cut, against what is part of a longer code.

Expectation-maximisation on the histogram of vote patterns (at most 4 kinds x 3**4) over all
documents estimates how often each labeler votes for, against or abstains given the truth, for each kind,
and the share of true spans; its posteriors weight the training of the
final span classifier, a regularised logistic regression on votes, kind and length class.
Looser candidates are added where that classifier is confident and no base span overlaps.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_batch, batches, stash, table, text_or_empty

KINDS = ("email", "ip", "card", "phone")
ADD_FROM = 0.9
ROUNDS = 100
#: Pseudo-candidates behind the share of true ones among a kind's candidates, a half.
SHARE_PSEUDO = 20
#: Pseudo-votes of each labeler, against, abstaining and for, given a true span (turned round for a false one); the strict form is surer.
PRIOR = ((0.4, 59.6, 140.0), (1.0, 3.0, 6.0), (1.0, 3.0, 6.0), (1.0, 3.0, 6.0))
CONTEXT = 40

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin at the start of a run of digits: later starts in the run meet the same end.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_FLAGS = re.IGNORECASE | re.ASCII
_NAME = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}"
_LABEL = "[A-Za-z0-9-]+"
#: Kind, what a text must contain for a match, the form.
_LOOSE = (
    (0, re.compile(r"[\[({](?:at|@)[\])}]", _FLAGS), re.compile(rf"{_NAME} ?[\[({{](?:at|@)[\])}}] ?{_LABEL}(?:(?:\.| ?[\[({{](?:dot|\.)[\])}}] ?){_LABEL})+", _FLAGS)),
    (0, re.compile(r" at [a-z0-9-]+ dot ", _FLAGS), re.compile(rf"{_NAME} at {_LABEL}(?: dot {_LABEL})+", _FLAGS)),
    (0, re.compile(" @|@ "), re.compile(rf"{_NAME}(?: @ ?| ?@ ){_LABEL}(?:\.{_LABEL})+", _FLAGS)),
    (1, re.compile(r"[0-9] ?(?:[\[(](?:\.|dot)[\])]|\.|dot) ?[0-9]", _FLAGS), re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?: ?[\[(](?:\.|dot)[\])] ?| \. | dot )[0-9]{1,3}){3}(?![0-9])", _FLAGS)),
    (3, re.compile("00[1-9]"), re.compile(r"(?<![0-9+(])00[1-9][0-9]{0,2}(?:[\x20.-]\(?[0-9]{2,4}\)?){2,4}(?![0-9])")),
    (3, re.compile("0[1-9]"), re.compile(r"(?<![0-9+(])\(?0[1-9][0-9]{1,3}\)?[\x20/-][0-9]{3,4}[\x20-]?[0-9]{3,4}(?![0-9])")),
    (3, None, re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")),
)
_UNDOTTED = re.compile(rf"{_NAME}@{_LABEL}(?![A-Za-z0-9.@-])", re.ASCII)
_HEX_RUN = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f:]{6,39}(?![0-9A-Za-z:])")

#: Gazetteers and cue words (fixed values).
TOP_DOMAINS = frozenset(
    "com org net edu gov mil int info biz name pro io co ai app dev tv me xyz online site shop"
    " ae ar at au be bg br by ca ch cl cn cz de dk ee eg es eu fi fr gr hk hr hu id ie il in iq ir is it jp ke kr kz"
    " lb lt lu lv ma mx my ng nl no nz pe ph pk pl pt ro rs ru sa se sg si sk th tn tr tw ua uk us uy vn za".split()
)
COUNTRY_CODES = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
    " 212 213 216 218 234 254 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 380 381 385 386 420 421 852 853 855 880 886 961 962 963 964 965 966 971 972 974".split()
)
CUES = {
    0: ("email", "e-mail", "mail", "mailto", "contact", "write to", "correo", "courriel"),
    1: ("ip", "ipv4", "ipv6", "host", "server", "addr", "address", "client", "gateway", "dns", "subnet", "peer"),
    2: ("card", "visa", "mastercard", "amex", "credit", "debit", "carte", "karte", "tarjeta"),
    3: ("phone", "telephone", "tel", "call", "fax", "mobile", "cell", "whatsapp", "telefon", "telefono", "teléfono", "téléphone", "handy"),
}
AGAINST = ("version", "isbn", "order", "invoice", "serial", "sku", "build", "release", "section", "page", "part no")


def _whole_words(words) -> re.Pattern:
    return re.compile(rf"(?<![^\W\d_])(?:{'|'.join(map(re.escape, words))})s?(?![^\W\d_])", re.IGNORECASE)


_CUES = {k: _whole_words(words) for k, words in CUES.items()}
_AGAINST = _whole_words(AGAINST)


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @: the run of local characters before it and the domain after it. Linear in the text."""
    out, last, low, at = [], 0, 0, text.find("@")
    while at >= 0:
        head = text[max(last, low) : at]
        start = max(last, low) + len(head.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        low = at + 1
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(kind, start, end) of the base patterns, by kind and start; and what has their shape but fails their checks."""
    found, failed = [(0, s, e) for s, e in emails(text)], []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((1, *m.span()))
        elif m.end() - m.start() <= 15:
            failed.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 13:
            continue
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
        elif 13 <= len(digits) <= 19:
            failed.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            n = sum(c.isdigit() for c in m[0])
            if 8 <= n <= 15:
                found.append((3, *m.span()))
            elif 6 <= n <= 18:
                failed.append((3, *m.span()))
    if "@" in text:
        failed += [(0, *m.span()) for m in _UNDOTTED.finditer(text)]
    return found, failed


def _fits(kind: int, span: str) -> bool:
    """Checks of looser forms that their patterns leave open: parts of a quad, digits of an international number, a known domain behind plain words."""
    if kind == 0:
        return " at " not in span.lower() or span.rsplit(" ", 1)[-1].lower() in TOP_DOMAINS
    if kind == 1:
        return all(int(p) <= 255 for p in re.findall("[0-9]+", span))
    return not span.startswith("00") or 8 <= sum(c.isdigit() for c in span) - 2 <= 15


def _is_ipv6(run: str) -> bool:
    try:
        ipaddress.IPv6Address(run)
    except ValueError:
        return False
    return True


def loose_spans(text: str, base: list, failed: list) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, form) of candidates beyond the base that overlap none of its spans, nor each other: of those that do, the leftmost,
    then the longest, then the looser form, then the first kind. Form 0 fails the base's checks, form 1 is looser. Patterns are local: linear in the text."""
    more = [(*f, 0) for f in failed]
    for kind, needs, form in _LOOSE:
        if needs is None or needs.search(text):
            more += [(kind, *m.span(), 1) for m in form.finditer(text) if _fits(kind, m[0])]
    if ":" in text:
        more += [(1, *m.span(), 1) for m in _HEX_RUN.finditer(text) if _is_ipv6(m[0])]
    if not more:
        return more
    starts, ends = [], []  # the base's spans, overlapping ones as one
    for s, e in sorted((s, e) for _, s, e in base):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    out = []
    for k, s, e, form in sorted(more, key=lambda x: (x[1], -x[2], -x[3], x[0])):
        if out and s < out[-1][2]:
            continue
        i = bisect_right(ends, s)
        if i < len(starts) and starts[i] < e:
            continue
        out.append((k, s, e, form))
    return sorted(out)


def _gazetteer(kind: int, span: str, digits: str) -> int:
    if kind == 0:
        return 2 if re.split("[^A-Za-z0-9-]+", span)[-1].lower() in TOP_DOMAINS else 0
    if kind == 1:
        if ":" in span:  # unicast, link-local and local ranges
            return 2 if int(span.split(":")[0] or "0", 16) >> 13 == 1 or span[:2].lower() in ("fe", "fc", "fd") else 0
        return 0 if re.match("[0-9]+", span)[0].lstrip("0") in ("", "255") else 2
    if kind == 2:
        issuer = digits[0] == "4" or "51" <= digits[:2] <= "55" or digits[:2] in ("34", "37", "65") or digits[:4] == "6011"
        return 2 if issuer else 1
    abroad = digits if span[0] == "+" else digits[2:] if digits[:2] == "00" else ""
    if abroad:
        return 2 if any(abroad[:n] in COUNTRY_CODES for n in (1, 2, 3)) else 1
    return 1 if digits[0] == "0" else 2 if digits[0] != "1" else 0


def vote(text: str, kind: int, start: int, end: int, form: int) -> int:
    """The four labelers' votes as a base-3 number (0 against, 1 abstains, 2 for). ``form``: 2 for a base span, 1 for a looser one, 0 for a failed one."""
    span = text[start:end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    pattern = form
    if kind == 2 and form < 2:
        pattern = 2 if 13 <= len(digits) <= 15 and luhn(digits) and digits[0] in "34" else 0
    gazetteer = _gazetteer(kind, span, digits)
    low = max(0, start - CONTEXT)
    if _AGAINST.search(text, low, start):
        context = 0
    elif _CUES[kind].search(text, low, start):
        context = 2
    else:
        around = text[low:start] + text[end : end + CONTEXT]
        letters = sum(map(str.isalpha, around))
        context = 2 if 2 * letters >= len(around) > 0 else 0 if 4 * letters < len(around) else 1
    left, right = text[start - 1 : start], text[end : end + 1]
    edges = 0 if left.isalnum() or right.isalnum() or left in ("-", "_", "/", "=") or right in ("-", "_", "/") else 2
    return ((pattern * 3 + gazetteer) * 3 + context) * 3 + edges


def pattern_code(text: str, kind: int, start: int, end: int, form: int) -> int:
    """Kind, votes and a length class: what the classifier sees of a span."""
    size = 0 if end - start < 12 else 1 if end - start < 18 else 2 if end - start < 26 else 3
    return (kind * 81 + vote(text, kind, start, end, form)) * 4 + size


N_CODES = len(KINDS) * 81 * 4


def _votes_of(code: int) -> tuple[int, ...]:
    v = code // 4 % 81
    return v // 27, v // 9 % 3, v // 3 % 3, v % 3


class SpanModel:
    """EM over the labelers, then a logistic regression on its posteriors. ``counts``: candidates of each pattern code."""

    def __init__(self, counts: np.ndarray):
        codes = np.flatnonzero(counts)
        self.probability = np.zeros(N_CODES)
        self.reliability: dict[str, list[tuple[float, float]]] = {}
        if not len(codes):
            return
        n = counts[codes].astype(np.float64)
        kind = codes // 324
        votes = np.array([_votes_of(int(c)) for c in codes])
        posterior = self._em(n, kind, votes)
        self._classifier(codes, n, kind, votes, posterior)

    def _em(self, n, kind, votes):
        """Labelers vote independently given the truth."""
        posterior = np.empty(len(n))
        for k in range(len(KINDS)):
            of = kind == k
            if not of.any():
                continue
            w, v = n[of], votes[of]
            prior = np.array([[p[::-1], p] for p in PRIOR])  # labeler, truth, vote
            rate = prior / prior.sum(axis=2, keepdims=True)
            share = 0.5
            for _ in range(ROUNDS):
                z = np.full(len(w), math.log(share / (1 - share)))
                for j in range(4):
                    z = z + np.log(rate[j, 1, v[:, j]] / rate[j, 0, v[:, j]])
                q = 1 / (1 + np.exp(-z))
                seen = prior.copy()
                for j in range(4):
                    np.add.at(seen[j, 1], v[:, j], w * q)
                    np.add.at(seen[j, 0], v[:, j], w * (1 - q))
                rate = seen / seen.sum(axis=2, keepdims=True)
                share = float(((w * q).sum() + SHARE_PSEUDO / 2) / (w.sum() + SHARE_PSEUDO))
            #: Of each labeler: how often it is for a true span, and against a false one.
            self.reliability[KINDS[k]] = [(float(rate[j, 1, 2]), float(rate[j, 0, 0])) for j in range(4)]
            posterior[of] = q
        return posterior

    def _classifier(self, codes, n, kind, votes, posterior):
        x = self._features(codes, kind, votes)
        weight = np.zeros(x.shape[1])
        scale = n / n.sum()
        for _ in range(25):  # Newton steps
            p = 1 / (1 + np.exp(-np.clip(x @ weight, -30, 30)))
            grad = x.T @ (scale * (posterior - p)) - 1e-4 * weight
            hess = (x * (scale * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(weight))
            weight += np.linalg.solve(hess, grad)
        every = np.arange(N_CODES)
        v = np.array([_votes_of(int(c)) for c in every])
        self.probability = 1 / (1 + np.exp(-np.clip(self._features(every, every // 324, v) @ weight, -30, 30)))

    @staticmethod
    def _features(codes, kind, votes):
        cols = [np.ones(len(codes))] + [(kind == k).astype(float) for k in range(1, 4)] + [(codes % 4 == s).astype(float) for s in range(1, 4)]
        cols += [((votes[:, j] == v)).astype(float) for j in range(4) for v in (0, 2)]
        return np.stack(cols, axis=1)


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("code", pa.int32()), ("base", pa.bool_())])
_CAND_SCHEMA = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(_SPAN))])


def find_candidates(text: str) -> list[tuple[int, int, int, int, bool]]:
    """(kind, start, end, pattern code, is a base span) of every candidate."""
    base, failed = base_spans(text)
    out = [(k, s, e, pattern_code(text, k, s, e, 2), True) for k, s, e in base]
    return out + [(k, s, e, pattern_code(text, k, s, e, form), False) for k, s, e, form in loose_spans(text, base, failed)]


def candidates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of ``docs`` with all of its candidates."""
    names = ("kind", "start", "end", "code", "base")

    def run(it):
        for b in batches(it, 256):
            spans = [[dict(zip(names, c, strict=True)) for c in find_candidates(t)] for t in b.column(1).to_pylist()]
            yield as_batch({"doc_id": b.column(0), "spans": spans}, _CAND_SCHEMA)

    kind = "doc_id long, spans array<struct<kind:int,start:int,end:int,code:int,base:boolean>>"
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(docs, text_column).alias("t")).mapInArrow(run, kind)


def fit(found: DataFrame) -> SpanModel:
    """From all candidates of all documents; at most 1,296 counts come to the driver."""
    counts = np.zeros(N_CODES)
    for code, n in found.select(F.explode("spans.code").alias("c")).groupBy("c").count().collect():
        counts[code] = n
    return SpanModel(counts)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


_OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
_OUT_SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_email", "n_ip", "n_card", "n_phone")] + [("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])


def find_pii(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans, one row for each row of ``docs``.

    Null text: as empty (no spans, the digest of nothing). Offsets are code points, ends
    exclusive. Spans of two base kinds may overlap; added ones overlap none. Repeated rows:
    each has its row. Empty table: no rows.
    """
    found = stash(candidates(docs), "op1-candidates")
    good = fit(found).probability >= ADD_FROM

    def run(it):
        for b in it:
            rows = []
            for d, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                base = sorted((x["kind"], x["start"], x["end"]) for x in spans if x["base"])
                added = [(x["kind"], x["start"], x["end"]) for x in spans if not x["base"] and good[x["code"]]]
                n = [sum(k == j for k, _, _ in base) for j in range(4)]
                rows.append((d, *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + added)), len(added)))
            if rows:
                yield as_batch(dict(zip(_OUT_SCHEMA.names, map(list, zip(*rows, strict=True)), strict=True)), _OUT_SCHEMA)

    return found.mapInArrow(run, _OUT)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, last = [], 0
    for s, e, k in sorted((s, -e, k) for k, s, e in spans):
        e = -e
        if s < last:
            if e > last:
                last = e
            continue
        out += [text[last:s], f"[{KINDS[k].upper()}]"]
        last = e
    return "".join(out) + text[last:]


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked and n_chars following the text; null texts stay null.

    Candidates are written beside the rows; rows without any never come to Python again.
    """
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    names = ("kind", "start", "end", "code", "base")
    span = T.StructType([*(T.StructField(n, T.IntegerType()) for n in names[:-1]), T.StructField("base", T.BooleanType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("_spans_", T.ArrayType(span))])

    def find(it):
        for b in batches(it, 256):
            spans = pa.array([[dict(zip(names, c, strict=True)) for c in find_candidates(t or "")] for t in b.column(at).to_pylist()], type=pa.list_(_SPAN))
            yield pa.RecordBatch.from_arrays([*b.columns, spans], names=[*b.schema.names, "_spans_"])

    rows = stash(docs.mapInArrow(find, schema), "op1-rows")
    good = fit(rows.select(F.col("_spans_").alias("spans"))).probability >= ADD_FROM

    def run(it):
        for b in batches(it, 256):
            old, texts = b.column(at).to_pylist(), []
            for t, found in zip(old, b.column(len(b.columns) - 1).to_pylist(), strict=True):
                spans = [(x["kind"], x["start"], x["end"]) for x in found if x["base"] or good[x["code"]]]
                texts.append(masked(t, spans) if spans else t)
            cols = list(b.columns)[:-1]
            if chars is not None:
                cols[chars] = pa.array([len(new) if new is not was else n for new, was, n in zip(texts, old, cols[chars].to_pylist(), strict=True)], type=cols[chars].type)
            cols[at] = pa.array(texts, type=cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1])

    return rows.filter("size(_spans_) > 0").mapInArrow(run, docs.schema).unionByName(rows.filter("size(_spans_) = 0").drop("_spans_"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
