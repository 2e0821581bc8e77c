"""Personal data by weak supervision.

Base spans (email, ip, card, phone) follow fixed rules and always stay. A loose search proposes further
candidates, most of which are nothing: runs of digits, dotted numbers, long tokens, pairs of capitalised
words. For every candidate, base spans included, three labelers vote for, against or
abstain: a *regex* labeler (strict form, check digits), a *gazetteer* labeler (known words, domains,
prefixes, titles), and a *context* labeler (cue words around the span). Expectation-maximisation over
the counts of vote patterns estimates, per kind, how often each labeler casts each vote on personal data and on other
text, and the posterior of every pattern. A logistic regression on votes and discrete features of the span is trained on
the posteriors of three quarters of the candidates; the threshold of a kind is the score that agrees best with the
posteriors of the last quarter. It decides which candidates become spans.

Votes and features take few values, so all rows of the corpus reduce to a table of counts that their number of values
bounds (some 20,000 patterns a kind; hundreds in practice); this is what EM and the regression see.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.common import by_slices, slices, word_store

BASE_KINDS = ["email", "ip", "card", "phone"]
#: Kinds that only the classifier adds, in the order in which spans of one start are listed.
MORE_KINDS = ["iban", "secret", "spelled_email", "ssn", "local_phone", "number", "name"]
KINDS = BASE_KINDS + MORE_KINDS
LABELERS = ["regex", "gazetteer", "context"]
#: Characters on either side of a span that the context labeler sees.
WINDOW = 40
EM_ROUNDS = 100
#: What EM adds to every count, and the candidates of a text in four that choose the threshold.
SMOOTHING, FOLDS = 0.5, 4

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_LOOSE = {
    "secret": re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}+={0,2}"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){8,30}+(?![A-Za-z0-9])"),
    "spelled_email": re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9._-]{2,64}(?: ?[\[(](?:at|AT)[\])] ?|@| at )[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(](?:dot|DOT)[\])]| dot ) ?[A-Za-z]{2,24})+"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}[- ]?[0-9]{2}[- ]?[0-9]{4}(?![0-9-])"),
    "local_phone": re.compile(r"(?<![0-9+(])(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ ./-]?)[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,2}(?![0-9])"),
    "number": re.compile(r"(?<![0-9.])[0-9](?:[ .-]?[0-9]){6,}+"),
    "name": re.compile(r"(?<![\w'])(?:(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Sr|Sra|Mme|M)\.? )?[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ'-]{1,40} [A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ'-]{1,40}(?![\w'])"),
}
_TITLE = re.compile(r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Sr|Sra|Mme|M)\.? ")
_DIGIT = re.compile("[0-9]")

# Fixed values of the gazetteers: top-level domains, call codes, issuer prefixes, countries with their account lengths, cue words.
TLDS = frozenset("com org net edu gov mil int info biz io co de fr es it uk us eu ch at be nl se no dk fi pl pt ru jp cn in br au ca mx ar".split())
CALL_CODES = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "7", "81", "82", "84", "86", "90", "91", "92", "93", "94", "98")
CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "60", "62", "64", "65", "35", "36", "38", "30", "50", "56", "57", "58", "63", "67")
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
CUES = {
    "email": ("mail", "contact", "write", "address", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "login", "client", "from"),
    "card": ("card", "visa", "master", "credit", "debit", "pay", "karte", "carte", "tarjeta"),
    "phone": ("tel", "phone", "call", "mobile", "fax", "dial", "handy", "móvil"),
    "secret": ("token", "secret", "key", "password", "passwd", "pwd", "auth", "bearer", "credential"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
    "local_phone": ("tel", "phone", "call", "mobile", "fax", "dial", "handy", "móvil"),
    "spelled_email": ("mail", "contact", "write", "reach"),
    "number": ("passport", "licence", "license no", "account", "customer no", "member", "ausweis", "kundennummer", "cuenta", "compte"),
    "name": ("dear", "sincerely", "signed", "contact", "regards", "name:", "author", "sehr geehrte", "estimad", "cher "),
}
FIRST_NAMES = frozenset("Anna Antonio Carlos Carmen Charles Claire David Elena Emma Francois Hans Isabel James Jean John Jose Juan Julia Karl Laura Linda Maria Marie Mark Martin Mary Michael Miguel Patricia Paul Peter Pierre Robert Sarah Sophie Thomas William".split())
SECRET_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "glpat-", "sk-", "sk_live_", "pk_live_", "xox", "AIza", "eyJ", "ya29")
AGAINST = ("version", "isbn", "issn", "doi", "http", "www", "sha", "commit", "md5", "section", "chapter")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int

    @property
    def order(self) -> tuple:
        return (self.start, KINDS.index(self.kind), self.end)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Each ``@`` with a domain takes the longest run of local characters before it, so no text is scanned twice."""
    free = 0  # behind the last match
    for m in _AT.finditer(text):
        at = start = m.start()
        while start > free and _LOCAL_END.match(text, start - 1):
            start -= 1
        if start < at:
            yield Span("email", start, m.end())
            free = m.end()
        else:
            free = max(free, at + 1)


def base_spans(text: str | None) -> list[Span]:
    """Leftmost non-overlapping matches of each base kind that pass its test, in order."""
    text = text or ""
    found = list(_emails(text)) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            found.append(Span("ip", *m.span()))
    for m in _DIGITS.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(Span("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append(Span("phone", *m.span()))
    return sorted(found, key=lambda s: s.order)


class _Taken:
    """Stretches of a text that spans occupy, none overlapping another that is added through ``free``."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        top = -1
        for a, b in sorted((s.start, s.end) for s in spans):
            if a < top:
                self.ends[-1] = top = max(top, b)
            else:
                self.starts.append(a)
                self.ends.append(b)
                top = b

    def free(self, a: int, b: int) -> bool:
        """Whether nothing is taken between ``a`` and ``b``; if so it is from now on."""
        at = bisect_right(self.starts, a)
        if at and self.ends[at - 1] > a or at < len(self.starts) and self.starts[at] < b:
            return False
        self.starts.insert(at, a)
        insort(self.ends, b)
        return True


def more_candidates(text: str, base: list[Span]) -> list[Span]:
    """Loose matches of the further kinds that touch no base span nor an earlier candidate."""
    taken = _Taken(base)
    digits = bool(_DIGIT.search(text))
    found = []
    for kind in MORE_KINDS:
        if not digits and kind in ("iban", "ssn", "local_phone", "number"):
            continue
        if kind == "spelled_email" and "@" not in text and "at" not in text and "AT" not in text:
            continue
        for m in _LOOSE[kind].finditer(text):
            if taken.free(*m.span()):
                found.append(Span(kind, *m.span()))
    return found


def candidates(text: str | None) -> tuple[list[Span], list[Span]]:
    text = text or ""
    base = base_spans(text)
    return base, more_candidates(text, base)


def _iban_ok(x: str) -> bool:
    x = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def _entropy(x: str) -> float:
    n = len(x)
    return -sum(c / n * math.log2(c / n) for c in Counter(x).values())


def regex_vote(kind: str, x: str) -> int:
    """Strict form of the kind: 1 if it has it, else -1."""
    digits = re.sub("[^0-9]", "", x)
    if kind == "email":
        ok = re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}", x)
    elif kind == "ip":
        ok = all(len(p) <= 3 for p in x.split(".")) and x[0] != "0"
    elif kind == "card":
        ok = len(digits) in (13, 14, 15, 16, 19) and len(set(digits)) > 2
    elif kind == "phone":
        ok = len(digits) >= 10 and x.count("(") == x.count(")")
    elif kind == "secret":
        ok = re.fullmatch(r"[0-9a-f]{32,}|[0-9A-F]{32,}|(?=[^ ]*[0-9])(?=[^ ]*[A-Za-z])[A-Za-z0-9_/+-]{20,}={0,2}", x) and _entropy(x) > 3
    elif kind == "iban":
        ok = _iban_ok(x)
    elif kind == "ssn":
        ok = re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", x) and x[:3] not in ("000", "666") and x[0] != "9" and x[4:6] != "00" and x[-4:] != "0000"
    elif kind == "local_phone":
        ok = 9 <= len(digits) <= 11 and re.fullmatch(r"\([0-9]{2,5}\) ?[0-9]{3,4}[ .-][0-9]{3,4}|0[0-9]{2,4}[ /-][0-9]{3,4}[ -]?[0-9]{2,4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}", x)
    elif kind == "number":
        ok = 12 <= len(digits) <= 19 and luhn(digits) or re.fullmatch(r"[0-9]{9}", x)
    elif kind == "spelled_email":
        ok = re.search(r"[\[(](?:at|AT)[\])]|@", x) and re.search(r"[A-Za-z]{2,24}$", x)
    else:
        ok = _TITLE.match(x) or all(3 <= len(w) <= 12 for w in x.split())
    return 1 if ok else -1


def gazetteer_vote(kind: str, x: str) -> int:
    """Known endings, prefixes, lengths, titles and names: 1, else -1; 0 where the list says nothing of the kind."""
    digits = re.sub("[^0-9]", "", x)
    if kind in ("email", "spelled_email"):
        return 1 if re.split(r"[^A-Za-z]", x)[-1].lower() in TLDS else -1
    if kind == "ip":
        return -1 if x.startswith(("0.", "127.", "255.")) else 1
    if kind in ("card", "number"):
        return 1 if digits.startswith(CARD_PREFIXES) and len(digits) > 12 else -1
    if kind == "phone":
        return 1 if digits.startswith(CALL_CODES) else -1
    if kind == "iban":
        return 1 if IBAN_LENGTHS.get(x[:2]) == len(x.replace(" ", "")) else -1
    if kind == "name":
        return 1 if _TITLE.match(x) or x.split()[0] in FIRST_NAMES else -1
    if kind == "secret":
        return 1 if x.startswith(SECRET_PREFIXES) else -1 if x.isalpha() or x.count("/") > 2 or x.count("-") > 2 else 0
    if kind == "ssn":
        return -1 if x[:3] in ("078", "219") or len(set(digits)) < 3 else 0
    return 1 if digits.startswith("0") or x[0] == "(" else -1


def context_vote(kind: str, text: str, start: int, end: int) -> int:
    """1 for a cue of the kind just around the span, -1 for a word that speaks against it or a sentence that begins with it."""
    before = text[max(0, start - WINDOW) : start].lower()
    around = before + " " + text[end : end + WINDOW // 2].lower()
    if any(w in around for w in CUES[kind]):
        return 1
    if any(w in around for w in AGAINST):
        return -1
    # of what looks like a word or number in prose, nothing around that names it speaks against it
    return -1 if kind in MORE_KINDS else 0


def _side(c: str) -> str:
    return "edge" if not c else "space" if c.isspace() else "quote" if c in "\"'`" else "word" if c.isalnum() else "mark"


def describe(text: str, s: Span) -> tuple[str, int, int, int, str]:
    """Kind, the three votes, and the discrete features of a span: length, share of digits, entropy, neighbours."""
    x = text[s.start : s.end]
    shape = "/".join([
        f"length{min(4, len(x) // 10)}", f"digits{round(3 * sum(map(str.isdigit, x)) / len(x))}", f"entropy{min(4, int(_entropy(x)))}",
        f"left-{_side(text[s.start - 1 : s.start] if s.start else '')}", f"right-{_side(text[s.end : s.end + 1])}",
    ])
    return s.kind, regex_vote(s.kind, x), gazetteer_vote(s.kind, x), context_vote(s.kind, text, s.start, s.end), shape


def fold_of(text_sum: int, span: Span) -> int:
    """A number under FOLDS from the whole text's CRC-32 and the span's place, so that reruns agree."""
    return zlib.crc32(b"%d:%d" % (text_sum, span.start)) % FOLDS


def pattern_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``kind, regex, gazetteer, context, shape, second, n`` over the candidates of all rows; ``second`` marks the last fold."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_store("pii")  # empties those of the stages before
        met: Counter = Counter()
        for batch in batches:
            for part in slices(batch):
                for text in part.column(0).to_pylist():
                    base, more = candidates(text)
                    if base or more:
                        total = zlib.crc32(text.encode("utf-8", "surrogatepass"))
                        met.update((*describe(text, s), fold_of(total, s) == FOLDS - 1) for s in base + more)
        rows = list(met.items())
        cols = [[k[i] for k, _ in rows] for i in range(6)]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *[pa.array(c, pa.int32()) for c in cols[1:4]], pa.array(cols[4], pa.string()), pa.array(cols[5], pa.bool_()), pa.array([n for _, n in rows], pa.int64())], names=["kind", *LABELERS, "shape", "second", "n"])

    counted = docs.select(text_col).mapInArrow(fn, "kind string, regex int, gazetteer int, context int, shape string, second boolean, n bigint")
    return counted.groupBy("kind", *LABELERS, "shape", "second").agg(F.sum("n").alias("n"))


def reliabilities(votes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM for one kind: ``(labelers, 2, 3)`` shares of the votes -1, 0, 1 on other text and on personal data, and the posterior of each pattern.

    It starts from the majority of the votes, which settles what a class means. No labeler is taken to be right.
    """
    cast = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)  # patterns, labelers, votes
    posterior = 1 / (1 + np.exp(-2.0 * votes.sum(1)))
    for _ in range(EM_ROUNDS):
        weight = np.stack([(1 - posterior) * n, posterior * n])  # classes, patterns
        prior = (weight.sum(1) + SMOOTHING) / (n.sum() + 2 * SMOOTHING)
        shares = np.einsum("cp,plv->lcv", weight, cast) + SMOOTHING
        shares /= shares.sum(2, keepdims=True)
        log = np.log(prior)[:, None] + np.einsum("plv,lcv->cp", cast, np.log(shares))
        posterior = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return shares, posterior


def _features(kind: str, votes: tuple[int, ...], shape: str) -> list[str]:
    return [f"{kind}", *[f"{kind}:{name}={v}" for name, v in zip(LABELERS, votes, strict=True)], *[f"{kind}:{x}" for x in shape.split("/")]]


@dataclass
class Model:
    """Weights of the span classifier by feature, thresholds by kind, and the labelers' estimated shares of votes by kind."""

    weights: dict[str, float]
    thresholds: dict[str, float]
    shares: dict[str, list]

    def score(self, described: tuple) -> float:
        kind, *votes, shape = described
        z = sum(self.weights.get(f, 0.0) for f in _features(kind, tuple(votes), shape))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def accepts(self, described: tuple) -> bool:
        return self.score(described) >= self.thresholds.get(described[0], 0.5)


def best_threshold(score: np.ndarray, posterior: np.ndarray, n: np.ndarray) -> float:
    """The middle of the gap between scores, among 0.2 to 0.8, whose two sides agree best with the posteriors; 0.5 on ties and without rows."""
    best, found = None, 0.5
    order = np.unique(np.round(score, 6))
    for t in sorted([0.5, *((order[1:] + order[:-1]) / 2)], key=lambda t: abs(t - 0.5)):
        if 0.2 <= t <= 0.8:
            agreed = (np.where(score >= t, posterior, 1 - posterior) * n).sum()
            if best is None or agreed > best + 1e-9:
                best, found = agreed, float(t)
    return found


def train(counts: DataFrame, rounds: int = 400, rate: float = 1.0, ridge: float = 0.01) -> Model:
    """EM, then logistic regression on the posteriors, from the table of counts; an empty table gives an empty model."""
    rows = sorted(tuple(r) for r in counts.select("kind", *LABELERS, "shape", "second", "n").collect())
    shares, target = {}, {}
    for kind in KINDS:
        mine: Counter = Counter()
        for r in rows:
            if r[0] == kind:
                mine[r[1:4]] += r[6]
        if mine:
            found, posterior = reliabilities(np.array(list(mine), float), np.array(list(mine.values()), float))
            shares[kind] = np.round(found, 6).tolist()
            target |= {(kind, *v): p for v, p in zip(mine, posterior, strict=True)}
    first = [r for r in rows if not r[5]]
    names = sorted({f for r in first for f in _features(r[0], r[1:4], r[4])})
    if not names:
        return Model({}, {}, shares)
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(first), len(names)))
    for i, r in enumerate(first):
        x[i, [at[f] for f in _features(r[0], r[1:4], r[4])]] = 1
    y = np.array([target[r[:4]] for r in first])
    # counts are damped, so that frequent patterns don't drown the others
    n = np.sqrt(np.array([r[6] for r in first], float))
    n /= n.sum()
    w, size = np.zeros(len(names)), np.full(len(names), 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (p - y)) + ridge * w / len(names)
        size += g * g
        w -= rate * g / np.sqrt(size)
    model = Model({f: round(float(v), 6) for f, v in zip(names, w, strict=True)}, {}, shares)
    for kind in KINDS:
        held = [r for r in rows if r[5] and r[0] == kind]
        score = np.array([model.score(r[:5]) for r in held])
        model.thresholds[kind] = best_threshold(score, np.array([target[r[:4]] for r in held]), np.array([r[6] for r in held], float)) if held else 0.5
    return model


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """The model of a table of texts. Null and empty texts have no candidates; an empty table gives a model that accepts nothing."""
    return train(pattern_counts(docs, text_col))


def spans_of(text: str | None, model: Model) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: the base and the candidates that the classifier accepts."""
    base, more = candidates(text)
    return base, sorted([*base, *[s for s in more if model.weights and model.accepts(describe(text, s))]], key=lambda s: s.order)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every whole text.

    Null and empty texts have no spans. Repeated rows give equal results. An empty table gives an empty result. Only
    ``doc_id`` (a whole number) and ``text`` are read.
    """
    learned = model or fit(docs)

    def fn(x: dict) -> dict:
        made = [spans_of(t, learned) for t in x["text"]]
        kinds = [Counter(s.kind for s in base) for base, _ in made]
        return {"doc_id": x["doc_id"]} | {f"n_{k}": [c[k] for c in kinds] for k in BASE_KINDS} | {
            "base_sha256": [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in made],
            "spans": [joined(every) for _, every in made],
        }

    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in BASE_KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(by_slices(fn, schema), "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in BASE_KINDS) + ", base_sha256 string, spans string")


def redacted_text(text: str | None, spans: list[Span]) -> str | None:
    """The text with every span replaced by its kind in angle brackets; spans that overlap are replaced as one."""
    if not spans:
        return text
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind.upper()}>"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with personal data replaced in ``text`` and ``n_chars`` (where there is one) brought up to date.

    Null texts stay null, empty ones empty; repeated rows are redacted alike; an empty table stays empty. All other
    columns, whatever their names, and all rows stay.
    """
    learned = model or fit(docs)
    names = docs.columns

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word_store("pii")
            at = batch.schema.get_field_index("text")
            for part in slices(batch):
                texts = [redacted_text(t, spans_of(t, learned)[1]) for t in part.column(at).to_pylist()]
                columns = [pa.array(texts, part.schema.field(at).type) if i == at else part.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    out = docs.mapInArrow(fn, docs.schema)
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))
    return out
