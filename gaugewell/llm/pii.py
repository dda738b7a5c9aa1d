"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Base spans are defined by patterns and always stay. Candidates are what else looks like personal data: written-out
addresses, numbers without a country code, other numbers with a check digit, names. On each candidate labelers of three
sorts vote yes, no or not at all: patterns and check digits, gazetteers, and the words around it. How often each
combination of votes occurs is counted over all documents; from these counts expectation-maximisation finds, per kind,
how often each labeler is right, without any labelled span. A logistic regression per kind then learns the posterior
from votes and from the span's shape, which no labeler sees, and decides.

Texts stay where they are: spans are found in one pass, counts are a grouped sum, and the models are a row per kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewell.llm import words as W
from gaugewell.llm.session import written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "id", "name")
LABELERS = ("form", "check", "gazetteer", "before", "around", "edges")
SHAPES = ("short", "grouped", "even", "bracket", "dotted", "lined", "upper", "opens", "ends")
#: A candidate that is not base counts as personal data from this probability on.
THRESHOLD = 0.5
#: Characters before and after a span that context labelers read.
BEFORE, AFTER = 48, 24
STEPS = 40
#: Pseudo-counts of the votes no, none and yes of each labeler if a span is none, and if it is one.
PRIOR = np.array([
    [[8, 30, 2], [8, 26, 6], [8, 24, 8], [12, 26, 2], [4, 34, 2], [16, 24, 0.5]],
    [[2, 20, 18], [2, 26, 12], [4, 24, 12], [1, 25, 14], [1, 33, 6], [2, 37, 0.5]],
])
#: Pseudo-counts of spans that are none, or ones; no more than half of a kind's candidates are taken to be ones.
PRIOR_SPANS = np.array([12.0, 6.0])
RIDGE = 1.0

# Base patterns. Quantifiers are possessive where what follows cannot start with what they take, and runs are taken
# whole, so that a search is linear in the text; matches are those of the same patterns with plain quantifiers.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Further candidates.
_SPELLED = re.compile(r"(?<![\w.+-])[\w.+-]{1,64}+\x20?[\[(]\x20?(?:at|AT|@)\x20?[\])]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?[\[(]\x20?(?:dot|DOT|\.)\x20?[\])]\x20?[A-Za-z0-9-]{1,63}+|\.[A-Za-z0-9-]{1,63}+){1,4}")
_IP6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_LOCAL = re.compile(r"(?<![0-9A-Za-z+(])(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20./-])[0-9]{2,5}(?:[\x20./-][0-9]{2,5}){1,3}(?![0-9A-Za-z])")
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")
_SOCIAL = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
_NAME = re.compile(r"(?<![^\W_])[A-ZÀ-Þ][a-zß-ÿ]{1,30}+\.?(?:\x20[A-ZÀ-Þ][a-zß-ÿ]{1,30}+){1,3}(?![^\W_])")

# Gazetteers.
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "professor", "sir", "herr", "frau", "monsieur", "madame", "mme", "mlle", "don", "doña", "señor", "señora", "sr", "sra"}
GIVEN = set(
    "james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph jessica thomas sarah "
    "charles karen daniel nancy matthew lisa anthony betty mark margaret paul sandra hans peter klaus jürgen ursula monika sabine "
    "andreas stefan jean marie pierre françois jacques isabelle nathalie michel maría josé juan carmen antonio ana luis laura carlos".split()
)
DOMAINS = {"com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at"}
#: Lengths of account numbers by country.
ACCOUNTS = {"DE": 22, "FR": 27, "ES": 24, "GB": 22, "IT": 27, "NL": 18, "CH": 21, "AT": 20, "BE": 16, "PT": 25}
CUES = {
    "email": {"email", "e-mail", "mail", "write", "contact", "kontakt", "courriel", "correo"},
    "ip": {"ip", "host", "server", "address", "login", "client", "adresse", "dirección"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "karte", "kreditkarte", "carte", "tarjeta"},
    "phone": {"phone", "tel", "telephone", "call", "fax", "mobile", "cell", "whatsapp", "telefon", "mobil", "téléphone", "teléfono", "móvil"},
    "id": {"ssn", "social", "iban", "account", "konto", "compte", "cuenta", "passport"},
    "name": {"name", "contact", "sincerely", "regards", "signed", "nom", "nombre", "patient", "employee", "customer"},
}
AGAINST = {"order", "invoice", "version", "isbn", "issn", "ref", "reference", "serial", "model", "part", "sku", "chapter", "section", "page", "doi", "build", "release", "hash", "ticket", "item", "art", "nr"}
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def _emails(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _EMAIL.finditer(text) if m.group(1)] if "@" in text else []


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Rank of the kind, start and end of the base spans, by kind, then start."""
    found = [(0, *span) for span in _emails(text)]
    found += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            found.append((2, *m.span()))
    found += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return found


def further_spans(text: str) -> list[tuple[int, int, int]]:
    """Candidates beyond the base spans; within a kind they do not overlap."""
    found = [(0, *m.span()) for m in _SPELLED.finditer(text)] if "(" in text or "[" in text else []
    found += [(1, *m.span()) for m in _IP6.finditer(text)] if ":" in text else []
    found += [(2, *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(_digits(m.group())) <= 19]
    found += [(3, *m.span()) for m in _LOCAL.finditer(text) if 7 <= len(_digits(m.group())) <= 12]
    found += [(4, *m.span()) for p in (_IBAN, _SOCIAL) for m in p.finditer(text)]
    return found + [(5, *m.span()) for m in _NAME.finditer(text)]


def _iban(text: str) -> bool:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def votes_of(kind: str, text: str, start: int, end: int, base: bool) -> list[int]:
    """The vote of each of :data:`LABELERS` on a candidate: 1, -1 or 0."""
    span, compact = text[start:end], re.sub(r"[\x20-]", "", text[start:end])
    before = [w.lower() for w in _WORD.findall(text[max(0, start - BEFORE) : start])][-6:]
    after = [w.lower() for w in _WORD.findall(text[end : end + AFTER])][:2]
    digits = _digits(span)
    form = check = gazetteer = 0
    if kind == "email":
        form, gazetteer = 1 if base or len(re.findall(r"[\[(]", span)) > 1 else 0, 1 if re.split(r"[^A-Za-z0-9]+", span.rstrip(")] "))[-1].lower() in DOMAINS else -1
    elif kind == "ip":
        parts = span.split(".")
        form = 1 if base or ":" in span else 0
        check = -1 if base and any(len(p) > 1 and p[0] == "0" for p in parts) else 0
        gazetteer = 1 if base and parts[0] in ("10", "127", "172", "192") else 0
    elif kind == "card":
        form = 1 if base else -1 if not re.fullmatch(r"[0-9]{13,19}|[0-9]{4}([\x20-])[0-9]{4,6}\1[0-9]{4,5}(\1[0-9]{1,4})?", span) else 0
        check = 1 if luhn(digits) else -1
        gazetteer = 1 if digits[0] in "3456" else -1
    elif kind == "phone":
        form = 1 if base else 1 if re.fullmatch(r"\([0-9]{3}\)\x20?[0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}", span) else 0
        check = -1 if re.fullmatch(r"(?:19|20)[0-9]{2}[./-][0-9]{2}[./-][0-9]{2,4}|[0-9]{2}[./-][0-9]{2}[./-](?:19|20)[0-9]{2}", span) else 0
        gazetteer = 1 if digits.startswith("00") else 0
    elif kind == "id":
        social = span[3] == "-"
        form = 0 if social else 1
        check = (1 if _iban(compact) else -1) if not social else -1 if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else 0
        gazetteer = (1 if ACCOUNTS.get(compact[:2]) == len(compact) else -1) if not social else 0
    else:
        parts = [w.lower() for w in _WORD.findall(span)]
        form = 1 if parts[0] in TITLES else 0
        gazetteer = 1 if any(w in GIVEN for w in parts) else 0
    cue, against = CUES[kind], AGAINST
    said = 1 if any(w in cue for w in before[-4:]) else -1 if any(w in against for w in before[-3:]) else 0
    around = 1 if any(w in cue for w in after) else 0
    touches = (start > 0 and (text[start - 1].isalnum() or text[start - 1] in "_/=#")) or (end < len(text) and (text[end].isalnum() or text[end] in "_/="))
    return [form, check, gazetteer, said, around, -1 if touches else 0]


def shape_of(text: str, start: int, end: int) -> list[int]:
    """The 0/1 features of :data:`SHAPES`."""
    span = text[start:end]
    groups = [len(x) for x in re.findall(r"[0-9]+", span)]
    edge = lambda c: c in "\n" or not c
    return [
        int(len(span) < 12), int(len(groups) > 1), int(len(set(groups)) == 1), int("(" in span or "[" in span), int("." in span), int("-" in span),
        int(any(c.isupper() for c in span)), int(edge(text[start - 1 : start])), int(edge(text[end : end + 1])),
    ]


SPAN = "struct<kind:int,start:int,end:int,base:boolean,inputs:array<int>>"


def document_spans(text: str) -> list[dict]:
    """All candidates of a text by kind, then start; those that overlap a base span, or an earlier kind's, are left out.

    Beyond the base spans only candidates that a labeler votes for are of use; others are left out too.
    """
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    found = [(k, s, e, True) for k, s, e in base]
    starts = [s for s, _ in taken]
    reach = np.maximum.accumulate([e for _, e in taken]).tolist() if taken else []
    extra, upto = [], {}
    for k, s, e in further_spans(text):
        i = int(np.searchsorted(starts, e, "left"))
        if i and reach[i - 1] > s:
            continue
        extra.append((s, e, k))
    for s, e, k in sorted(extra, key=lambda x: (x[0], x[2])):
        if s >= upto.get("end", 0):
            upto["end"] = e
            found.append((k, s, e, False))
    rows = []
    for k, s, e, is_base in sorted(found):
        votes = votes_of(KINDS[k], text, s, e, is_base)
        if is_base or max(votes) > 0:
            rows.append({"kind": k, "start": s, "end": e, "base": is_base, "inputs": votes + shape_of(text, s, e)})
    return rows


def candidates(docs: DataFrame, *keep: str, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` with its candidate ``spans``, written once."""
    names = [f"_k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text_col).alias("_text"))
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("inputs", pa.list_(pa.int32()))]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.sized(batch, "_text"):
                spans = [document_spans(t or "") for t in part.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(spans, kind)], names=[*names, "spans"])

    fields = ", ".join([*(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, rows.schema.fields, strict=False)), f"spans array<{SPAN}>"])
    found = written(rows.mapInArrow(find, fields), "candidates")
    return found.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "spans")


def weigh(votes: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each combination of votes (n x labelers, counted), and P(vote | class) as 2 x labelers x 3, by EM.

    A labeler whose yes is more frequent in spans that are none tells nothing: both classes then have the mean of its rows.
    """
    table = PRIOR / PRIOR.sum(2, keepdims=True)
    share = PRIOR_SPANS / PRIOR_SPANS.sum()
    posterior = np.zeros(len(votes))
    for _ in range(steps):
        scores = np.log(share)[:, None] + sum(np.log(table[:, j, votes[:, j] + 1]) for j in range(votes.shape[1]))
        posterior = 1 / (1 + np.exp(np.clip(scores[0] - scores[1], -500, 500)))
        weight = np.stack([(1 - posterior) * counts, posterior * counts])
        share = weight.sum(1) + PRIOR_SPANS
        share = np.maximum(share / share.sum(), [0.5, 0.0])
        share = share / share.sum()
        seen = np.stack([[(weight * (votes[:, j] == v)).sum(1) for v in (-1, 0, 1)] for j in range(votes.shape[1])])
        table = seen.transpose(2, 0, 1) + PRIOR
        table = table / table.sum(2, keepdims=True)
        odds = table[..., 2] / (table[..., 2] + table[..., 0])
        table = np.where((odds[1] < odds[0])[None, :, None], table.mean(0, keepdims=True), table)
    return posterior, table


def inputs_of(values: np.ndarray) -> np.ndarray:
    """The classifier's inputs: a constant, each vote as two of 0 and 1, and the shape."""
    votes = values[:, : len(LABELERS)]
    return np.column_stack([np.ones(len(values)), votes > 0, votes < 0, values[:, len(LABELERS) :]]).astype(float)


def train(inputs: np.ndarray, target: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Weights of a ridge logistic regression of the posterior, by Newton steps."""
    w = np.zeros(inputs.shape[1])
    ridge = np.eye(len(w)) * RIDGE
    ridge[0, 0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(inputs @ w, -30, 30)))
        step = np.linalg.solve((inputs * (counts * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ inputs + ridge, inputs.T @ (counts * (target - p)) - ridge @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model(NamedTuple):
    """Of each kind that has candidates: the classifier's weights, and the labelers' P(vote | class), flat (2 x labelers x 3)."""

    weights: dict[int, list[float]]
    reliabilities: dict[int, list[float]]


def fit(found: DataFrame) -> Model:
    """A model from the candidates of all documents (:func:`candidates`).

    Candidates that are not base are counted per kind and combination of votes and shape; there are at most 3**6 * 2**9 of these, and
    far fewer occur. A kind's are one group, and a row per kind is what comes back.
    """
    counted = found.select(F.inline(F.filter("spans", lambda s: ~s["base"]))).groupBy("kind", "inputs").agg(F.count(F.lit(1)).alias("n"))

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(order=frame["inputs"].map(tuple)).sort_values("order")
        values, counts = np.array(frame["inputs"].tolist()), frame["n"].to_numpy(float)
        posterior, table = weigh(values[:, : len(LABELERS)], counts)
        return pd.DataFrame([[int(frame["kind"].iloc[0]), train(inputs_of(values), posterior, counts).tolist(), table.ravel().tolist()]], columns=["kind", "weights", "reliabilities"])

    rows = counted.groupBy("kind").applyInPandas(learn, "kind int, weights array<double>, reliabilities array<double>").collect()
    return Model({r.kind: list(r.weights) for r in rows}, {r.kind: list(r.reliabilities) for r in rows})


def _probability(span: Column, model: Model) -> Column:
    """The classifier's probability of a candidate; 0 for a kind without a model."""
    n = len(LABELERS)
    votes, shape = F.slice(span["inputs"], 1, n), F.slice(span["inputs"], n + 1, len(SHAPES))
    values = F.concat(F.array(F.lit(1)), F.transform(votes, lambda v: (v > 0).cast("int")), F.transform(votes, lambda v: (v < 0).cast("int")), shape)
    found = F.lit(0.0)
    for kind, weights in sorted(model.weights.items()):
        score = F.aggregate(F.zip_with(values, F.array(*[F.lit(w) for w in weights]), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
        found = F.when(span["kind"] == kind, 1 / (1 + F.exp(-score))).otherwise(found)
    return found


def personal_data(docs: DataFrame, *keep: str, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, and ``spans``: kind, start, end, base and probability, by kind, then start.

    Starts and ends count code points, the end exclusive. Base spans have probability 1. One row per row:
    null and empty texts have no spans, nulls and repeats in other columns are kept as they are, an empty table gives no
    rows. A column of ``keep`` may not be called ``spans``.
    """
    if "spans" in keep:
        raise ValueError("a column to keep is called spans")
    found = candidates(docs, *keep, text_col=text_col)
    model = fit(found)
    names = F.array(*[F.lit(k) for k in KINDS])
    scored = F.transform("spans", lambda s: F.struct(F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), F.when(s["base"], 1.0).otherwise(_probability(s, model)).alias("probability")))
    return found.select(*keep, F.filter(scored, lambda s: s["base"] | (s["probability"] >= threshold)).alias("spans"))
