"""Personal data: fixed patterns that always count, and candidates that boosted trees select.

Everything that touches the rows is DataFrame functions. ``split`` and ``regexp_extract_all`` with
one pattern give the text between matches and the matches, whose lengths give every position.

Base kinds (email, ip, card, phone) are fixed patterns with fixed checks; they are always kept. High
recall generators propose further spans, which may overlap: values after words such as "password",
long tokens that hold a digit, groups of digits, account numbers. Gradient-boosted trees over the
candidate's format and the text before it score each one; a Platt calibration turns the score into a
probability, and ``THRESHOLDS`` select. Selected candidates that overlap a base span go; those that
overlap each other become one span, of the likeliest one's kind. The trees are trained on the driver
on ``TRAINING`` rows that a fixed rule makes up (the tables hold no labels for spans) and run as one
SQL expression.

Patterns are possessive and start at the edge of a run, so they take time linear in the text and no
stack, whatever the text. Positions are running sums, made in as many passes as the number of matches
has binary digits; no step copies what it found so far for each further match. A text is held as a
whole, with its matches, while its row is worked on.

Defined results: null and empty texts have no spans; equal texts (so repeated rows too) have equal
spans; positions are code points, ends exclusive; candidates of equal probability: the kind that is
listed first in ``KINDS``; an empty table gives an empty result; ``find`` reads doc_id and text only,
``redacted`` keeps all other columns, whatever their names (attestra_base, attestra_more and
attestra_spans are its own).
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, in the forms that never start inside a run that an earlier start would have matched.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"(?:\G|(?<![0-9]))[0-9]++(?:[\x20-][0-9]++)*+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "iban", "id")

_CUE = r"(?i)(?:password|passwd|passphrase|pwd|token|secret|api.?key|key|auth|bearer|credentials?)[^A-Za-z0-9]{0,4}$"
_ID_CUE = r"(?i)(?:ssn|social|passport|iban|account|konto|cuenta|compte|licen[cs]e|dni|nif|steuer|tel|telefon|phone|call|fax|mobile|id)[^A-Za-z0-9]{0,4}$"
GENERATORS = {  # name: (kind, pattern, what must be in the text, group of the span or None)
    "assigned": ("secret", r"(?i)(?<![A-Za-z])(?:password|passwd|passphrase|pwd|token|secret|api[_-]?key|access[_-]?key|auth)\s{0,3}[:=]\s{0,3}[\"']?[^\s\"']{6,}+", r"[:=]", r"[:=]\s{0,3}[\"']?([^\s\"']{6,}+)$"),
    "token": ("secret", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+", r"[0-9]", None),
    "account": ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+", r"[A-Z]{2}[0-9]{2}", None),
    "digits": ("id", r"(?:\G|(?<![0-9.,]))[0-9]++(?:[\x20().-]{1,2}[0-9]++)++", r"[0-9]", None),
}
THRESHOLDS = {"secret": 0.5, "iban": 0.6, "id": 0.7}
TRAINING, ROUNDS, DEPTH, RATE = 4000, 16, 3, 0.5
CONTEXT = 32
BLOCK = 4096  # code points of the pieces that a text is cut from


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(xs: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Entry i joins the entries up to i: each pass reaches twice as far back."""

    def passes(x: Column) -> Column:
        far = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.size(x).cast("double"))).cast("int") - 1, F.lit(0)))
        return F.aggregate(far, x, lambda done, k: F.transform(done, lambda v, i: F.coalesce(join(v, F.get(done, i - F.call_function("shiftleft", F.lit(1), k))), v)))

    return _let(xs, lambda x: F.when(F.size(x) > 1, passes(x)).otherwise(x))


def spans(text: Column, pattern: str, needs: str) -> Column:
    """start, end, value and the ``CONTEXT`` characters before, of the pattern's matches, left to right."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(between, found, lambda b, v: F.struct(F.char_length(b).alias("gap"), F.char_length(v).alias("size"), v.alias("value"), F.right(b, F.lit(CONTEXT)).alias("before")))
    empty = F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")

    def placed(p: Column) -> Column:
        ends = _running(F.transform(p, lambda x: x["gap"] + F.coalesce(x["size"], F.lit(0))), lambda x, y: x + y)
        each = F.zip_with(p, ends, lambda x, e: F.struct((e - x["size"]).alias("start"), e.alias("end"), x["value"].alias("value"), x["before"].alias("before")))
        return F.filter(each, lambda x: x["value"].isNotNull())

    return F.when(text.rlike(needs), _let(parts, lambda p: F.when(F.size(p) > 1, placed(p)).otherwise(empty))).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    each = F.transform(F.split(digits, ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def _small(part: Column) -> Column:
    rest = F.regexp_replace(part, "^0+", "")
    return (F.char_length(rest) < 3) | ((F.char_length(rest) == 3) & (rest <= "255"))


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each base kind."""
    size = lambda s: F.char_length(_digits(s["value"]))
    return {
        "email": spans(text, _EMAIL, "@"),
        "ip": F.filter(spans(text, _IP, r"[0-9]\.[0-9]"), lambda s: F.forall(F.split(s["value"], r"\."), _small)),
        "card": F.filter(F.filter(spans(text, _CARD, r"[0-9](?:[\x20-]?[0-9]){11}"), lambda s: size(s).between(12, 19)), lambda s: _luhn(s["value"])),
        "phone": F.filter(spans(text, _PHONE, r"\+[0-9]"), lambda s: size(s).between(9, 15)),
    }


# Candidate features, each as a pattern to count or test, for SQL and for training alike.
COUNTED = (r"[0-9]", r"[A-Z]", r"[a-z]", r"[ ().:/-]", r"[0-9a-fA-F]", r"[A-Za-z][0-9]|[0-9][A-Za-z]", r"[aeiouAEIOU]", r"[0-9]+")
TESTED = (r"^[A-Z]{2,4}[0-9A-Z]+$", r"^[0-9]{3}[-. ]?[0-9]{2}[-. ]?[0-9]{4}$", r"^\(?[0-9]{3}[). -]{1,2}[0-9]{3}[. -][0-9]{4}$", r"^(?:19|20)[0-9]{2}[-. /]")
NAMES = ["len", *(f"count{i}" for i in range(len(COUNTED))), *(f"test{i}" for i in range(len(TESTED))), "cue", "id_cue", *(f"by_{g}" for g in GENERATORS)]


def _features(value: str, before: str, generator: str) -> list[float]:
    n = max(len(value), 1)
    counts = [len(re.findall(p, value)) for p in COUNTED]
    return [n, *(c / n for c in counts[:-1]), counts[-1], *(bool(re.search(p, value)) for p in TESTED), bool(re.search(_CUE, before)), bool(re.search(_ID_CUE, before)), *(g == generator for g in GENERATORS)]


def _feature_columns(c: Column, generator: str) -> dict[str, Column]:
    n = F.greatest(F.char_length(c["value"]), F.lit(1)).cast("double")
    out = {"len": n}
    for i, p in enumerate(COUNTED):
        count = F.regexp_count(c["value"], F.lit(p)).cast("double")
        out[f"count{i}"] = count if i == len(COUNTED) - 1 else count / n
    for i, p in enumerate(TESTED):
        out[f"test{i}"] = c["value"].rlike(p).cast("double")
    out["cue"], out["id_cue"] = c["before"].rlike(_CUE).cast("double"), c["before"].rlike(_ID_CUE).cast("double")
    return out | {f"by_{g}": F.lit(float(g == generator)) for g in GENERATORS}


def training_rows(n: int, seed: int = 13) -> tuple[list[list[float]], list[int]]:
    """Made-up candidates: what the generators find in formats that are personal or secret, and in formats that are not."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    d, hexes, upper, mixed, lower = "0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(r.choice(("the", "ing", "ver", "on", "ar", "le", "tion", "est", "un", "de")) for _ in range(r.randint(1, 4)))
    plain = lambda: f"{word()} {word()} "
    cue, id_cue = lambda: plain() + r.choice(("password=", "token = \"", "key: ", "secret ", "auth=")), lambda: plain() + r.choice(("ssn ", "phone: ", "tel ", "account ", "id "))
    good = [
        lambda: (pick(upper, 4) + pick(upper, r.randint(12, 24)), r.choice((plain, cue))(), "token"),
        lambda: (pick(hexes, r.randint(18, 64)), r.choice((plain, cue, cue))(), "token"),
        lambda: (pick(mixed, r.randint(18, 44)), r.choice((plain, cue))(), "token"),
        lambda: (r.choice((pick(hexes, r.randint(8, 40)), pick(mixed, r.randint(8, 24)), word() + pick(d, r.randint(2, 4)))), plain(), "assigned"),
        lambda: (f"{pick(d, 3)}-{pick(d, 2)}-{pick(d, 4)}", r.choice((plain, id_cue))(), "digits"),
        lambda: (r.choice((f"({pick(d, 3)}) {pick(d, 3)}-{pick(d, 4)}", f"{pick(d, 3)}-{pick(d, 3)}-{pick(d, 4)}", f"{pick(d, 3)}.{pick(d, 3)}.{pick(d, 4)}"))[0:], r.choice((plain, id_cue))(), "digits"),
        lambda: (pick(upper[:26], 2) + pick(d, 2) + " ".join(["", *(pick(d, 4) for _ in range(r.randint(3, 6)))]), r.choice((plain, id_cue))(), "account"),
    ]
    bad = [
        lambda: ("-".join(word() for _ in range(r.randint(3, 6))) + f"-{r.randint(1, 99)}", plain(), "token"),
        lambda: (word() + word() + word() + str(r.randint(1, 2030)), plain(), "token"),
        lambda: ("/".join([word(), word(), str(r.randint(1, 999)), word()]), plain(), "token"),
        lambda: (f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", plain(), "digits"),
        lambda: (f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1900, 2030)}", plain(), "digits"),
        lambda: (".".join(str(r.randint(0, 30)) for _ in range(r.randint(2, 3))), plain(), "digits"),
        lambda: (f"{r.randint(1, 999)}-{r.randint(1, 999)}", plain(), "digits"),
        lambda: (" ".join(str(r.randint(0, 3000)) for _ in range(r.randint(2, 6))), plain(), "digits"),
        lambda: (pick(upper[:26], 2) + pick(d, 2) + " " + " ".join(pick(upper[:26], r.randint(3, 6)) for _ in range(3)), plain(), "account"),
        lambda: (r.choice(("required", "optional", "invalid", "expired", "missing")), plain(), "assigned"),
    ]
    rows, labels = [], []
    for i in range(n):
        makers = good if i % 2 else bad
        value, before, generator = makers[i // 2 % len(makers)]()
        rows.append(_features(value, before[-CONTEXT:], generator))
        labels.append(i % 2)
    return rows, labels


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree on gradients: (feature, cut, left, right) or a leaf's value."""
    leaf = float(-RATE * g.sum() / (h.sum() + 1))
    if depth == 0 or len(x) < 20:
        return leaf
    best = (1e-3, -1, 0.0)
    score = lambda a, b: a * a / (b + 1)
    for f in range(x.shape[1]):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 15), method="nearest")):
            left = x[:, f] <= cut
            if 5 <= left.sum() <= len(x) - 5:
                gl, hl = g[left].sum(), h[left].sum()
                gain = score(gl, hl) + score(g.sum() - gl, h.sum() - hl) - score(g.sum(), h.sum())
                if gain > best[0]:
                    best = (gain, f, float(cut))
    if best[1] < 0:
        return leaf
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], _tree(x[left], g[left], h[left], depth - 1), _tree(x[~left], g[~left], h[~left], depth - 1)


def _run(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, cut, a, b = tree
    return np.where(x[:, f] <= cut, _run(a, x), _run(b, x))


@cache
def model() -> tuple[tuple, float, float]:
    """The trees and the calibration, from three quarters and one quarter of the training rows."""
    rows, labels = training_rows(TRAINING)
    x, y = np.array(rows, float), np.array(labels, float)
    held = np.arange(len(x)) % 8 >= 6
    z, trees = np.zeros(len(x)), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-z))
        tree = _tree(x[~held], (p - y)[~held], (p * (1 - p))[~held], DEPTH)
        trees.append(tree)
        z += _run(tree, x)
    a, b = 1.0, 0.0
    zs, ts = z[held], np.where(y[held] == 1, 0.99, 0.01)
    for _ in range(200):
        p = 1 / (1 + np.exp(-(a * zs + b)))
        a -= 0.05 * float(((p - ts) * zs).mean())
        b -= 0.05 * float((p - ts).mean())
    return tuple(trees), a, b


def _tree_column(tree, at: dict[str, Column]) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    f, cut, a, b = tree
    return F.when(at[NAMES[f]] <= cut, _tree_column(a, at)).otherwise(_tree_column(b, at))


def probability(features: dict[str, Column]) -> Column:
    trees, a, b = model()
    total = sum((_tree_column(t, features) for t in trees[1:]), _tree_column(trees[0], features))
    return 1 / (1 + F.exp(-(F.lit(a) * total + F.lit(b))))


def _proposed(text: Column, generator: str) -> Column:
    """The generator's candidates: start, end, kind and features."""
    kind, pattern, needs, group = GENERATORS[generator]
    found = spans(text, pattern, needs)
    if group:
        inner = lambda s: F.regexp_extract(s["value"], group, 1)
        found = F.transform(
            found, lambda s: F.struct((s["end"] - F.char_length(inner(s))).cast("int").alias("start"), s["end"].alias("end"), inner(s).alias("value"), s["before"].alias("before"))
        )
    features = lambda s: F.struct(*[v.alias(k) for k, v in _feature_columns(s, generator).items()])
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), s["end"].alias("end"), features(s).alias("f")))


def _candidates(text: Column) -> Column:
    """The candidates of all generators that pass their kind's threshold, as (start, k, end, p)."""
    scored = F.transform(
        F.concat(*(_proposed(text, g) for g in GENERATORS)),
        lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"), probability({k: s["f"][k] for k in NAMES}).alias("p")),
    )
    least = F.array(*[F.lit(THRESHOLDS.get(k, 0.0)) for k in KINDS])
    return F.filter(scored, lambda s: s["p"] >= F.get(least, s["k"]))


def _merged(found: Column, kind: Callable[[Column], Column]) -> Column:
    """Spans in order of start (one at least) with overlapping ones as one span; ``kind`` chooses its k from those it holds."""

    def merge(x: Column, ends: Column) -> Column:
        opens = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.coalesce(F.get(ends, i - 1) <= F.get(x, i)["start"], F.lit(True)))

        def one(at: Column, stop: Column) -> Column:
            held = F.slice(x, at + 1, stop - at)
            return F.struct(F.get(x, at)["start"].alias("start"), _let(held, kind).alias("k"), F.get(ends, stop - 1).alias("end"), F.array_max(F.transform(held, lambda s: s["p"])).alias("p"))

        return _let(opens, lambda o: F.transform(o, lambda at, j: one(at, F.coalesce(F.get(o, j + 1), F.size(x)))))

    return _let(found, lambda x: _let(_running(F.transform(x, lambda s: s["end"]), F.greatest), lambda ends: merge(x, ends)))


def _likeliest(held: Column) -> Column:
    return F.array_max(F.transform(held, lambda s: F.struct(s["p"].alias("p"), (-s["k"]).alias("minus")))).getField("minus") * -1


def _resolve(base: Column, more: Column) -> Column:
    """All base spans, and the candidates that overlap none of them, overlapping ones as one span."""
    of_base = lambda s: s["k"] < len(BASE)

    def free(x: Column) -> Column:
        behind = _running(F.transform(x, lambda s: F.when(of_base(s), s["end"]).otherwise(0)), F.greatest)
        ahead = F.reverse(_running(F.reverse(F.transform(x, lambda s: F.when(of_base(s), s["start"]).otherwise((1 << 31) - 1))), F.least))
        return _let(behind, lambda b: _let(ahead, lambda a: F.filter(x, lambda s, i: ~of_base(s) & (F.get(b, i) <= s["start"]) & (F.get(a, i) >= s["end"]))))

    added = _let(_let(F.array_sort(F.concat(base, more)), free), lambda x: F.when(F.size(x) > 0, _merged(x, _likeliest)).otherwise(x))
    return F.array_sort(F.concat(base, added))


def _listed(found: Column, k: int) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end"), F.lit(1.0).alias("p")))


def with_spans(docs: DataFrame, base: str = "base", spans_: str = "spans") -> DataFrame:
    """``docs`` with text (null: empty) and its spans in the two columns named; other columns stay."""
    listed = [_listed(found, i) for i, found in enumerate(base_spans(F.col("text")).values())]
    rows = docs.withColumn("text", F.coalesce("text", F.lit("")))
    told = rows.withColumn(base, F.array_sort(F.concat(*listed))).withColumn("attestra_more", _candidates(F.col("text")))
    merged = F.when(F.size("attestra_more") == 0, F.col(base)).otherwise(_resolve(F.col(base), F.col("attestra_more")))
    return told.withColumn(spans_, merged).drop("attestra_more")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text, base (array of start, k, end) and spans (the same with the selected candidates) of every row; k indexes ``KINDS``."""
    return with_spans(docs.select("doc_id", "text"))


def listing(spans_: Column) -> Column:
    """kind:start:end, comma-joined, in order of start and kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from start to end of a text in blocks of ``BLOCK``: no step counts from the text's beginning."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    piece = lambda at, begin, size: F.coalesce(F.substring(F.get(blocks, at), begin, size), F.lit(""))
    middle = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    return F.when(first == last, piece(first, start % BLOCK + 1, end - start)).otherwise(F.concat(piece(first, start % BLOCK + 1, F.lit(BLOCK)), middle, piece(last, F.lit(1), end % BLOCK)))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in angle brackets; overlapping spans become one, of the first one's kind."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    text, found = F.col("text"), F.col("attestra_spans")

    def told(blocks: Column, x: Column) -> Column:
        before = F.transform(x, lambda s, i: F.concat(_cut(blocks, F.coalesce(F.get(x, i - 1)["end"], F.lit(0)), s["start"]), F.get(names, s["k"])))
        return F.concat(F.array_join(before, ""), _cut(blocks, F.get(x, F.size(x) - 1)["end"], F.char_length(text)))

    blocks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))
    whole = _let(blocks, lambda b: _let(_merged(found, lambda held: F.get(held, F.lit(0))["k"]), lambda x: told(b, x)))
    return with_spans(docs, "attestra_base", "attestra_spans").withColumn("text", F.when(F.size(found) == 0, text).otherwise(whole)).drop("attestra_base", "attestra_spans")
