"""Personal data: high-recall generators, gradient-boosted trees, calibrated thresholds.

Base spans (email, ip, card, phone) follow fixed patterns and checks. Beside them generators propose further,
overlapping candidates: written-out emails, phone numbers without a plus sign, cards of 13 to 15 digits, IPv6 addresses, bank accounts, social security numbers. Boosted trees
score each candidate by format (lengths of its groups, check sums, number plans, known domains) and context (words that announce it or that
announce something else, numbers beside it). No table labels candidates, so examples are made in the places of the corpus:

- positive are candidates that cover a rewrite of a base span in its place, or an invented address or number put into a quiet place, most of them after words
  that announce it, and account numbers of the corpus that pass the mod-97 check;
- negative are candidates inside base spans of other kinds or inside longer numbers, account numbers that fail the check, and numbers of other
  sorts put into quiet places: years, versions, serials, orders, prices, dates, measures, table rows, times, plain words around "at" and "dot".

On a fold of documents that the trees have not seen, each kind gets the lowest threshold that keeps the wanted precision; a kind without
examples of both classes is never added. A user's labelled findings count as examples of their documents, in place of made ones. Candidates above their threshold
that touch no base span are added, best first, and none that goes on in a number beside it: the rest of a longer number is left alone, or taken whole.

Training takes the examples of about ``train_docs`` documents chosen by hash, of these about ``train_rows`` (documented bounds); whole texts are
read. Finding and redacting are single Arrow passes over whole texts without a shuffle.

Defined results: a null or empty text has no span (redacting leaves it as it is); equal rows get equal results;
without candidates nothing is added; an empty table gives an empty result; further columns are
ignored by ``find`` and kept by ``redact``. Starts and ends count code points, the end is exclusive.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import bounded_rows, map_batches, materialize, text_slices

TRAIN_DOCS, TRAIN_ROWS = 12_000, 40_000
PRECISION = 0.995
#: Quiet places of a document that examples are put into, for each base span and at least.
PLACES = 4
#: Held-out examples of each class that a kind needs to get a threshold.
LEAST_HELD = 10
#: Characters beside a candidate that are looked at.
BEFORE, AFTER = 40, 10
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "ssn")
#: Kinds that the generators propose.
JUDGED = ("email", "ip", "card", "phone", "account", "ssn")

# The patterns of the base kinds.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # starting within digits gives nothing new
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# Generators beyond the base kinds.
_AT, _DOT = r"(?: ?[\[({<_]at[\])}>_] ?| at )", r"(?: ?[\[({<_]dot[\])}>_] ?| dot )"
# An "at" is looked for first, then what follows it and what goes before.
_MARK, _HEAD = re.compile(_AT, re.I), re.compile(rf"[A-Za-z0-9](?:[A-Za-z0-9._%+-]|{_DOT}(?=[A-Za-z0-9._%+-]))*$", re.I)
_TAIL = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{2,24}}){{1,3}}(?![A-Za-z0-9])", re.I)
_DOTTED_TAIL = re.compile(r"[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{2,24}){1,3}")
_LOOSE_PHONE = re.compile(r"(?<![0-9A-Za-z+.])(?:1[ .-])?\(?[0-9]{2,5}\)?(?:[ .-][0-9]{2,4}){2,4}(?![0-9A-Za-z])")
_SSN = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
_ACCOUNT = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
_SHORT_CARD = re.compile(r"(?<![0-9A-Za-z.-])[0-9](?:[ -]?[0-9]){12,14}(?![0-9A-Za-z])")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
#: What goes on with a number: a digit, at most one separator away from it.
_GOES_ON_BEFORE, _GOES_ON_AFTER = re.compile(r"[0-9][A-Za-z0-9]{0,8}[ ./:-]?$"), re.compile(r"[ ./:-]?[A-Za-z0-9]{0,8}[0-9]")

# Words that announce personal data, by kind, and words that announce other numbers; top-level domains; lengths of account numbers by country.
_CUES = (
    re.compile(r"\be?-?mail|contact|write to|kontakt|courriel|correo|reach", re.I),
    re.compile(r"phone|fono|\btel\b|\bcall|\bfax\b|mobile|\bcell\b|\bruf|anruf|\bappel|\bllam|\bring\b|reach|\bdial\b|whatsapp|handy\b|my number", re.I),
    re.compile(r"\bcard|\bvisa\b|\bamex\b|credit|karte\b|\bcarte|tarjeta", re.I),
    re.compile(r"account|\biban\b|\bbank|konto\b|\bcompte|cuenta|transfer|\bpay", re.I),
    re.compile(r"ssn|social security|sozialvers|sécurité sociale|seguridad social|taxpayer", re.I),
    re.compile(r"\bip\b|ipv6|host|server|address|adresse|login from", re.I),
    re.compile(r"order|serial|version|release|\bpart\b|\blot\b|model|invoice|page|room|isbn|year|code|bestell|rechnung|seite|commande|facture|pedido|factura|\bno\.|#|sku|batch|ticket|\bcase\b|\bref|total|price|build|between|tracking|article|item|\bid\b|number of|score|table|mm\b|km\b", re.I),
)
_TLDS = frozenset("com org net edu gov io de fr es uk info eu ch at it nl co us me dev app biz ca au".split())
_STOP = frozenset("the a an this that these our your my his her its all it is was are be look meet stay arrived arrive stop and or of in on for with to he she they we you i not one two noon night home once least most work school".split())
_IBAN_LENGTHS = {"DE": 22, "FR": 27, "ES": 24, "GB": 22, "IT": 27, "NL": 18, "AT": 20, "CH": 21, "BE": 16, "PT": 25, "PL": 28, "SE": 24, "DK": 18, "NO": 15, "FI": 18, "IE": 22, "LU": 20}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def proposals(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, holds) of everything that matches a base pattern; ``holds``: it passes the check."""
    out = [("email", a, b, True) for a, b in _emails(text)] if "@" in text else []
    if not re.search("[0-9]", text):
        return out
    out += [("ip", m.start(), m.end(), all(map(_small, m[0].split(".")))) for m in _IP.finditer(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 7:
            digits = _NOT_DIGIT.sub("", m[0])
            if len(digits) >= 7:
                out.append(("card", m.start(), m.end(), 16 <= len(digits) <= 19 and luhn(digits)))
    if "+" in text:
        out += [("phone", m.start(), m.end(), 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15) for m in _PHONE.finditer(text)]
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    return [x[:3] for x in proposals(text) if x[3]]


def _alone(text: str, a: int, b: int) -> bool:
    """Whether no number goes on with text[a:b]."""
    return not _GOES_ON_BEFORE.search(text[max(0, a - 12) : a]) and not _GOES_ON_AFTER.match(text[b : b + 12])


def _spelt_emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    for mark in _MARK.finditer(text):
        tail = _TAIL.match(text, mark.end()) or (_DOTTED_TAIL.match(text, mark.end()) if mark[0] != " at " else None)
        head = _HEAD.search(text[max(last, mark.start() - 80) : mark.start()]) if tail else None
        if head:
            yield mark.start() - len(head[0]), tail.end()
            last = tail.end()


def further(text: str) -> list[tuple[str, int, int]]:
    """Candidates of the wide generators; they may overlap."""
    out = [("email", a, b) for a, b in _spelt_emails(text)]
    numbers = []
    if re.search("[0-9]{2}", text):
        numbers += [("phone", m.start(), m.end()) for m in _LOOSE_PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 12]
        numbers += [("ssn", m.start(), m.end()) for m in _SSN.finditer(text)]
        numbers += [("card", m.start(), m.end()) for m in _SHORT_CARD.finditer(text)]
    if re.search(":[0-9A-Fa-f]{0,4}:", text):
        numbers += [("ip", m.start(), m.end()) for m in _IPV6.finditer(text) if m.end() - m.start() >= 5]
    if re.search("[A-Z]{2}[0-9]{2}", text):
        out += [("account", m.start(), m.end()) for m in _ACCOUNT.finditer(text)]
    return out + [x for x in numbers if _alone(text, x[1], x[2])]


def account_holds(shown: str) -> bool:
    """The mod-97 check of international bank account numbers."""
    x = shown.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def _is_ipv6(shown: str) -> bool:
    try:
        ipaddress.IPv6Address(shown)
    except ValueError:
        return False
    return True


def describe(kind: str, shown: str, before: str, after: str) -> list[float]:
    """Format and context features of one candidate."""
    digits = _NOT_DIGIT.sub("", shown)
    n, letters = len(shown), sum(c.isalpha() for c in shown)
    groups = re.findall("[0-9]+", shown)
    sizes = [*map(len, groups), 0, 0, 0, 0][:4]
    counts = [shown.count(c) for c in set(shown)]
    spelt = kind == "email"
    names = re.split(rf"{_AT}|{_DOT}|\.", shown, flags=re.I) if spelt else []
    at = re.search(_AT, shown, re.I) if spelt else None
    domain = re.split(rf"{_DOT}|\.", shown[at.end() :], flags=re.I)[0].lower() if at else ""
    local = shown[: at.start()].lower() if at else ""
    # of the words before, those that stand nearer count more
    last = max((m.end() for m in _CUES[-1].finditer(before)), default=-1)
    own = {"email": 0, "phone": 1, "card": 2, "account": 3, "ssn": 4, "ip": 5}[kind]
    mine = max((m.end() for m in _CUES[own].finditer(before)), default=-1)
    return [
        *(float(kind == k) for k in KINDS),
        n, len(digits), letters / n, len(groups), *sizes, float(len(set(map(len, groups))) == 1),
        sum(len(g) == 4 and g[:2] in ("19", "20") for g in groups), float(digits[:1] == "0"), float(len(set(digits)) < 4),
        float(luhn(digits)) if 12 <= len(digits) <= 19 else -1.0, float(digits[:2] in ("34", "37")) + 2 * float(digits[:2] in ("30", "36", "38")) + 3 * float(digits[:1] == "4"),
        float(account_holds(shown)) + float(_IBAN_LENGTHS.get(shown[:2]) == len(shown.replace(" ", ""))) if kind == "account" else -1.0,
        float(_is_ipv6(shown)) if kind == "ip" else -1.0,
        float(groups[0] not in ("000", "666") and groups[0][0] != "9" and groups[1] != "00" and groups[2] != "0000") if kind == "ssn" else -1.0,
        float(names[-1].lower() in _TLDS) if names else -1.0, float(domain in _STOP), float(local in _STOP), float(bool(names) and names[-1].lower() in _TLDS and domain not in _STOP and local not in _STOP), float(bool(at) and at[0] != " at "), float(bool(re.search("[0-9._+-]", local))),
        -sum(c / n * math.log2(c / n) for c in counts),
        shown.count("."), shown.count("-"), shown.count("("), shown.count(" "), shown.count(":"),
        float(before[-1:].isspace() or not before), float(after[:1].isspace() or not after), float(bool(re.match(r" ?(?:[%€$£]|mm|km|kg|usd|eur|euro|units|pages|points)", after, re.I))), float(bool(re.search(r"[%€$£#/=] ?$", before))),
        float(mine >= 0), float(last >= 0), float(mine - last), *(float(bool(c.search(before))) for i, c in enumerate(_CUES[:-1]) if i != own),
    ]


_ATS = (" at ", " AT ", " (at) ", " [at] ", "(at)", "[at]", "{at}", " <at> ", "_at_")
_DOTS = (" dot ", " DOT ", " (dot) ", " [dot] ", "(dot)", "[dot]", "{dot}", " <dot> ", "_dot_")


def rewrites(kind: str, shown: str) -> list[str]:
    """Other ways to write a base span."""
    if kind == "email":
        local, domain = shown.split("@", 1)
        return [f"{name}{at}{domain.replace('.', dot)}" for (at, dot), name in zip(zip(_ATS[::3], _DOTS[::3], strict=True), (local, local.replace(".", _DOTS[0]), local), strict=True)]
    if kind == "phone":
        local = re.sub(r"^\+[0-9]+ ?", "", shown)
        groups = re.findall("[0-9]+", local)
        return list(dict.fromkeys([local, *(sep.join(groups) for sep in " -."), f"{groups[0]} {'-'.join(groups[1:])}"])) if groups else []
    return []


def _number(r: random.Random, shape: str) -> str:
    """``shape`` with digits in place of 0 (any) and 9 (not zero), and years in place of Y."""
    return "".join(r.choice("0123456789") if c == "0" else r.choice("123456789") if c == "9" else str(r.randrange(1900, 2040)) if c == "Y" else c for c in shape)


def _with_luhn(r: random.Random, first: str, n: int) -> str:
    body = first + "".join(r.choice("0123456789") for _ in range(n - len(first) - 1))
    return next(body + d for d in "0123456789" if luhn(body + d))


def _account(r: random.Random) -> str:
    country, n = r.choice(list(_IBAN_LENGTHS.items()))
    body = "".join(r.choice("0123456789") for _ in range(n - 4))
    rest = int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    whole = f"{country}{98 - rest:02d}{body}"
    return whole if r.random() < 0.3 else " ".join(whole[i : i + 4] for i in range(0, n, 4))


def _spelt(r: random.Random, words: list[str]) -> str:
    w = lambda: r.choice(words).lower()
    k = r.randrange(len(_ATS))
    at, dot = (_ATS[k], _DOTS[k]) if r.random() < 0.7 else (r.choice(_ATS), r.choice(_DOTS))
    local = r.choice([w(), f"{w()}.{w()}", f"{w()}_{w()}", f"{w()}{r.randrange(1, 999)}", f"{w()[0]}.{w()}", f"{w()}{dot}{w()}", f"{w()}+{w()}", f"{w()[0]}{w()}"])
    domain = r.choice([w(), f"{w()}-{w()}", f"{w()}{r.randrange(1, 99)}", f"{w()}{dot}{w()}"])
    tld = r.choice([*sorted(_TLDS), f"co{dot}uk", "com", "org", "net", "com"])
    return f"{local}{at}{domain}{dot if r.random() < 0.85 or at in (' at ', ' AT ') else '.'}{tld}"


# Shapes of phone numbers (9: not zero) and of numbers that are none; words that go before each.
_PHONES = ("(900) 000-0000", "900-000-0000", "900.000.0000", "900 000 0000", "900 000-0000", "1-900-000-0000", "0900 000 0000", "090 0000 0000", "09 00 00 00 00", "0900-000-000", "(090) 0000 0000", "1 900 000 0000", "900 00 00 00", "(900) 000 0000", "(0900) 000-0000", "90 0000 0000")
_PHONE_CUES = ("call ", "phone: ", "tel. ", "fax ", "mobile: ", "ring me on ", "reach us at ", "Telefon ", "rufen Sie an: ", "appelez le ", "llame al ", "my number is ", "contact: ", "dial ", "WhatsApp ", "cell ")
_OTHERS = (
    "Y Y Y", "Y-Y-Y", "Y Y Y", "Y-00-00 0000", "Y-10-12 0000", "Y-0000-000", "9.Y.1103", "00:00:00:00:00:00", "00:00:00", "90.000.0000", "9000-0000-0000", "900-000-0000", "900 000 0000", "90 000 000", "900 000 000", "9 000 000 000", "2024-05-12 0000", "48.858 90.000 90", "978-0-00-000000", "978-900-0000",
    "0001 0002 0003", "900 900 900", "20 15 21 18", "900.000.000", "0000.0000.0000", "900-00-0000", "900-00-0000", "900-900-900", "09 10 11 12 13", "0900 000 000", "(900) 000-0000", "900000000000000", "9000 000000 00000", "9000000000000", "90:00:00", "00:1a:2b:3c:4d:5e", "9:00:00:00", "1:2:3", "AB00 0000 0000 0000 0000 00", "DE00 0000 0000 0000 0000 00",
)
_OTHER_CUES = ("order ", "serial ", "version ", "part ", "lot number ", "invoice ", "page ", "room ", "ISBN ", "years ", "code ", "Bestellung ", "Rechnung ", "Seite ", "commande ", "facture ", "pedido ", "no. ", "#", "SKU ", "batch ", "ticket ", "ref ", "total ", "build ", "between ", "tracking ", "article ", "table ", "score ", "", "", "", "at ", "of ", "and ")


def invented(r: random.Random, words: list[str]) -> tuple[str, str | None, str]:
    """(words before, kind or None for no personal data, what is put in)."""
    pick = r.random()
    if pick < 0.14:
        return r.choice(["mail ", "write to ", "contact ", "e-mail: ", "", "", "ask "]), "email", _spelt(r, words)
    if pick < 0.32:
        return r.choice(_PHONE_CUES), "phone", _number(r, r.choice(_PHONES))
    if 0.32 <= pick < 0.58 and r.random() < 0.3:  # announced, but it fails its check
        wrong = _account(r)
        wrong = wrong[:2] + f"{(int(wrong[2:4]) + r.randrange(1, 90)) % 97:02d}" + wrong[4:]
        card = _with_luhn(r, r.choice(["34", "37", "4", "36"]), r.choice([13, 14, 15]))
        card = card[:-1] + str((int(card[-1]) + r.randrange(1, 10)) % 10)
        return r.choice([("account ", None, wrong), ("IBAN ", None, wrong), ("pay to ", None, wrong), ("card ", None, card), ("SSN ", None, f"{r.choice([0, 666, 900 + r.randrange(99)]):03d}-{r.randrange(100):02d}-{r.randrange(10000):04d}"), ("ip ", None, _number(r, "00:00:00"))])
    if pick < 0.38:
        return r.choice(["SSN ", "ssn: ", "social security number ", "taxpayer ", "Sozialversicherung "]), "ssn", f"{r.choice([*range(1, 666), *range(667, 900)]):03d}-{r.randrange(1, 100):02d}-{r.randrange(1, 10000):04d}"
    if pick < 0.45:
        return r.choice(["IBAN ", "account ", "pay to ", "Konto ", "compte ", "cuenta ", "", "bank: "]), "account", _account(r)
    if pick < 0.52:
        x = r.choice([_with_luhn(r, r.choice(["34", "37"]), 15), _with_luhn(r, r.choice(["34", "37"]), 15), _with_luhn(r, r.choice(["30", "36", "38"]), 14), _with_luhn(r, "4", 13)])
        sep = r.choice(["", " ", "-"])
        return r.choice(["card ", "Amex ", "credit card: ", "carte ", "tarjeta ", ""]), "card", sep.join([x[:4], x[4:10], x[10:]])
    if pick < 0.58:
        parts = [f"{r.randrange(65536):x}" for _ in range(8)]
        cut = r.randrange(1, 6)
        return r.choice(["ip ", "host ", "server ", "address ", "login from ", ""]), "ip", r.choice([":".join(parts), f"2001:db8::{':'.join(parts[:cut])}", f"fe80::{parts[0]}:{parts[1]}", f"{parts[0]}:{parts[1]}:{parts[2]}::{parts[3]}"])
    if pick < 0.66:
        w = lambda: r.choice(words)
        dot = r.choice([" dot ", " DOT ", " dot "])
        return "", None, r.choice([f"{w()} at {w()}{dot}{w()}", f"{w()} at the{dot}com {w()}", f"meet at noon{dot}{w()}", f"look at {r.choice(['this', 'the', 'a', 'one'])}{dot}{w()}", f"{w()} at {w()} {w()}{dot}{w()}", f"{w()} at least one{dot}{w()}"])
    return r.choice(_OTHER_CUES), None, _number(r, r.choice(_OTHERS))


def features_at(text: str, kind: str, a: int, b: int) -> list[float]:
    return describe(kind, text[a:b], text[max(0, a - BEFORE) : a], text[b : b + AFTER])


def _inserted(text: str, a: int, b: int, shown: str) -> tuple[str, int, int]:
    """The surroundings of text[a:b] with ``shown`` in its place, and the place."""
    left = text[max(0, a - 2 * BEFORE) : a]
    return left + shown + text[b : b + 2 * BEFORE], len(left), len(left) + len(shown)


def _covers(a: int, b: int, start: int, end: int) -> bool:
    """Whether the span (a, b) is about the span (start, end)."""
    return 2 * (min(b, end) - max(a, start)) > max(b - a, end - start)


class BoostedTrees:
    """Gradient boosting of small trees over quantile bins, logistic loss."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 16):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.cuts = [(u[1:] + u[:-1]) / 2 if len(u := np.unique(c)) <= 2 * self.bins else np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "right") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base, self.trees = math.log(share / (1 - share)), []
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            tree: dict[int, tuple] = {}
            f += self.rate * self._grow(tree, 0, 0, binned, y - q, q * (1 - q), np.arange(len(y)))
            self.trees.append(tree)
        return self

    def _grow(self, tree, node, depth, b, g, h, rows) -> np.ndarray:
        out = np.zeros(len(g))
        best, gain = None, 1e-6
        if depth < self.depth and len(rows) > 8:
            for j in range(b.shape[1]):
                size = len(self.cuts[j]) + 1
                gs = np.cumsum(np.bincount(b[rows, j], g[rows], size))
                hs = np.cumsum(np.bincount(b[rows, j], h[rows], size))
                if size > 1:
                    got = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                    k = int(got[:-1].argmax())
                    if got[k] > gain:
                        best, gain = (j, k), got[k]
        if best is None:
            value = g[rows].sum() / (h[rows].sum() + 1)
            tree[node] = (value,)
            out[rows] = value
            return out
        j, k = best
        tree[node] = (j, self.cuts[j][k])
        low = b[rows, j] <= k
        return self._grow(tree, 2 * node + 1, depth + 1, b, g, h, rows[low]) + self._grow(tree, 2 * node + 2, depth + 1, b, g, h, rows[~low])

    def predict(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for tree in self.trees:
            size = max(tree) + 1
            column, cut, value = np.zeros(size, int), np.full(size, np.nan), np.zeros(size)
            for node, what in tree.items():
                if len(what) == 2:
                    column[node], cut[node] = what
                else:
                    value[node] = what[0]
            at = np.zeros(len(x), int)
            while (inner := ~np.isnan(cut[at])).any():
                low = x[rows, column[at]] < cut[at]
                at = np.where(inner, 2 * at + np.where(low, 1, 2), at)
            f += self.rate * value[at]
        return 1 / (1 + np.exp(-f))


#: The feature that tells whether a word of its own kind announces a candidate.
ANNOUNCED = len(KINDS) + 33


class Finder:
    """Trees and thresholds; finds all spans of a text. A kind has one threshold for candidates that a word announces and one for others."""

    def __init__(self, trees: BoostedTrees | None = None, thresholds: dict[str, tuple[float, float]] | None = None):
        self.trees, self.thresholds = trees, thresholds or {}

    def spans(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """Base spans, and base spans with those that the trees add; by kind, then start."""
        base = base_spans(text)
        new = [x for x in further(text) if x[0] in self.thresholds and not any(x[1] < e and s < x[2] for _, s, e in base)]
        added: list[tuple[str, int, int]] = []
        if new:
            found = np.array([features_at(text, *x) for x in new])
            scores = self.trees.predict(found)
            for q, x, announced in sorted(zip(-scores, new, found[:, ANNOUNCED].astype(int).tolist(), strict=True)):
                if -q >= self.thresholds[x[0]][announced] and not any(x[1] < e and s < x[2] for _, s, e in added):
                    added.append(x)
        place = lambda x: (KINDS.index(x[0]), x[1])
        return sorted(base, key=place), sorted(base + added, key=place)


def examples(text: str) -> list[tuple[str, int, list[float]]]:
    """(kind, label, features) of candidates of the generators, real ones whose label a text tells and those put into its places."""
    out, seen = [], proposals(text)
    base = [x[:3] for x in seen if x[3]]
    r = random.Random(hashlib.md5(text.encode()).digest())

    def put(a: int, b: int, before: str, kind: str | None, shown: str) -> None:
        near, start, end = _inserted(text, a, b, before + shown)
        start += len(before)
        out.extend((k, int(k == kind and _covers(s, e, start, end)), features_at(near, k, s, e)) for k, s, e in further(near) if s < end and start < e)

    for kind, a, b in further(text):
        if kind == "account":
            out.append((kind, int(account_holds(text[a:b])), features_at(text, kind, a, b)))
            continue
        other = any(s <= a and b <= e and k != kind for k, s, e in base)
        longer = any(s <= a and b <= e and k == "card" and not holds and len(_NOT_DIGIT.sub("", text[s:e])) >= 16 for k, s, e, holds in seen)
        if other or longer:
            out.append((kind, 0, features_at(text, kind, a, b)))
    for kind, a, b in base:
        for new in rewrites(kind, text[a:b]):
            put(a, b, "", kind, new)
    quiet = [m.end() for m in re.finditer(r"[^\W\d_] (?=[^\W\d_])", text) if not any(s - BEFORE <= m.end() <= e + BEFORE for _, s, e in base)]
    words = list(dict.fromkeys(re.findall(r"[a-z]{2,12}", text[:20_000])))
    for _ in range(PLACES + len(base) if quiet and len(words) > 3 else 0):
        at = r.choice(quiet)
        before, kind, shown = invented(r, words)
        put(at, at, before, kind, f"{shown}{r.choice([' ', ', ', '. ', ' '])}" if kind is None else shown + r.choice([" ", ", ", ". ", " "]))
    return out


def train(docs: DataFrame, labelled: DataFrame | None = None, train_docs: int = TRAIN_DOCS, train_rows: int = TRAIN_ROWS, precision: float = PRECISION) -> Finder:
    """Trees from candidates of the corpus, and the thresholds that a held-out fold gives.

    ``labelled`` are findings of a user: doc_id, kind, start, end and personal (1 or 0) of candidates of ``docs``.
    """
    sampled = bounded_rows(docs.select("doc_id", "text"), train_docs, "doc_id").filter(F.length("text") > 0)
    given = F.array().cast("array<struct<kind:string,start:long,end:long,personal:int>>")
    rows = sampled.select("text", given.alias("given"))
    if labelled is not None:
        of = labelled.groupBy("doc_id").agg(F.collect_list(F.struct("kind", F.col("start").cast("long"), F.col("end").cast("long"), F.col("personal").cast("int"))).alias("given"))
        rows = rows.unionByName(docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(of, "doc_id").select("text", F.col("given").cast(rows.schema["given"].dataType)))
    kinds = (pa.int32(), pa.string(), pa.int32(), pa.list_(pa.float64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                got = []
                for text, said in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    fold = hashlib.md5(text.encode()).digest()[0] % 4
                    got += [(fold, k, y, x) for k, y, x in ([] if said else examples(text))]
                    got += [(fold, g["kind"], g["personal"], features_at(text, g["kind"], g["start"], g["end"])) for g in said]
                yield pa.record_batch([pa.array([g[i] for g in got], k) for i, k in enumerate(kinds)], ["fold", "kind", "y", "x"])

    found = map_batches(rows, run, "fold int, kind string, y int, x array<double>")
    got = bounded_rows(materialize(found), train_rows).orderBy("fold", "kind", "y", "x").toArrow()
    y, fold, kind = (np.array(got[c].to_pylist()) for c in ("y", "fold", "kind"))
    if min(((y == k) & (fold > 0)).sum() if len(y) else 0 for k in (0, 1)) < 8:
        return Finder()
    x = np.array(got["x"].to_pylist())
    trees = BoostedTrees().fit(x[fold > 0], y[fold > 0].astype(float))
    held = fold == 0
    return Finder(trees, calibrate(trees.predict(x[held]), kind[held], y[held], x[held, ANNOUNCED], precision))


def calibrate(scores: np.ndarray, kind: np.ndarray, y: np.ndarray, announced: np.ndarray, precision: float = PRECISION) -> dict[str, tuple[float, float]]:
    """The lowest thresholds that keep the precision, of each kind without and with a word that announces it; infinite where no score does."""
    out = {}
    for k in JUDGED:
        if min(((kind == k) & (y == c)).sum() for c in (0, 1)) < LEAST_HELD:
            continue
        each = []
        for said in (0, 1):
            chosen = (kind == k) & (announced == said)
            q, right = scores[chosen], y[chosen]
            order = np.argsort(-q, kind="stable")
            share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
            ends = np.r_[np.diff(q[order]) != 0, True] if len(order) else np.zeros(0, bool)  # ties stand or fall together
            good = np.flatnonzero((share >= precision) & ends)
            last = int(good[-1]) if len(good) else 0  # halfway to the first example that would cost too much
            each.append(max(0.5, float(q[order][last : last + 2].mean())) if len(good) else math.inf)
        out[k] = tuple(each)
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, finder: Finder) -> DataFrame:
    """doc_id, base counts by kind, base_sha256 and spans of every row."""
    ids = docs.select("doc_id", "text")
    counts = [f"n_{k}" for k in BASE_KINDS]
    out = T.StructType([ids.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in counts), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                found = [finder.spans(t or "") for t in part.column(1).to_pylist()]
                n = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in BASE_KINDS]
                digest = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found]
                yield pa.record_batch([part.column(0), *n, pa.array(digest, pa.string()), pa.array([_joined(a) for _, a in found], pa.string())], out.names)

    return map_batches(ids, run, out)


def redact(docs: DataFrame, finder: Finder) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; n_chars follows the text."""

    def replaced(text: str) -> str:
        pieces, at = [], 0
        for a, b, k in sorted((a, b, k) for k, a, b in finder.spans(text)[1]):
            if b > at:  # spans of different kinds may overlap
                pieces += [text[at : max(a, at)], f"[{k}]"] if a >= at else []
                at = b
        return "".join([*pieces, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                at = part.schema.get_field_index("text")
                columns = list(part.columns)
                columns[at] = pa.array([t and replaced(t) for t in columns[at].to_pylist()], columns[at].type)
                yield pa.record_batch(columns, part.schema.names)

    kept = map_batches(docs, run, docs.schema)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept
