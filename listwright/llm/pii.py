"""Operator 7: private data replaced by keyed surrogates of the same kind, gender, script and format."""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm.common import fewer, forgotten, tune, written

#: The key of tests and of the registered query; production gives its own.
KEY = b"listwright surrogates"
#: After so many attempts a surrogate no longer keeps the lengths that leave too few others.
NARROW, ROUNDS = 8, 64

# Reserved domains, forms of address with the gender they tell, and given names by script and gender.
DOMAINS = ("example.com", "example.net", "example.org")
TITLES = {
    "m": ("Mr.", "Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr.", "Господин"),
    "f": ("Mrs.", "Mrs", "Ms.", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Señorita", "Sra.", "Srta.", "Dra.", "Госпожа"),
    "n": ("Dr.", "Prof.", "Doctor", "Professor"),
}
#: What may follow a form of address and is nobody's name.
NOBODY = frozenset("america earth universe world pac-man kitty".split())
GIVEN = {
    ("LATIN", "m"): ("Adrian", "Bernard", "Conrad", "Daniel", "Edgar", "Felix", "Gregor", "Hugo", "Ivan", "Julian", "Konstantin", "Leon", "Martin", "Norbert", "Oscar", "Paul", "Ruben", "Simon", "Tobias", "Victor"),
    ("LATIN", "f"): ("Adela", "Beatrice", "Clara", "Diana", "Elena", "Flora", "Gloria", "Helena", "Irene", "Julia", "Katarina", "Laura", "Marina", "Nadia", "Olivia", "Paula", "Rosa", "Silvia", "Teresa", "Vera"),
    ("CYRILLIC", "m"): ("Андрей", "Борис", "Виктор", "Григорий", "Денис", "Егор", "Захар", "Иван", "Кирилл", "Леонид", "Максим", "Николай", "Олег", "Павел", "Роман", "Сергей"),
    ("CYRILLIC", "f"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Ксения", "Лариса", "Мария", "Нина", "Ольга", "Полина", "Раиса", "Софья"),
}
GIVEN |= {(script, "n"): GIVEN[script, "m"] + GIVEN[script, "f"] for script in ("LATIN", "CYRILLIC")}  # of titles that tell no gender
VOWELS = set("aeiouyáéíóúàèìòùâêîôûäëïöüåæøœаеёиоуыэюяαεηιουωάέήίόύώ")
ALPHABETS = {"LATIN": "abcdefghijklmnopqrstuvwxyz", "CYRILLIC": "абвгдежзиклмнопрстуфхцчшщэюя", "GREEK": "αβγδεζηθικλμνξοπρστυφχψω"}

#: Words inside a name that stay as they are; those with a full stop are academic titles.
PARTICLES = frozenset("von van vom zu zum zur de del della di da do dos das du des la le las los den der ten ter af av bin ibn el al st".split())
ACADEMIC = frozenset(("dr.", "prof."))

def _marks() -> str:
    """Ranges of the combining signs of scripts that write vowels with them, for a class of signs."""
    out, start = [], None
    for c in range(0x300, 0x3100):
        on = unicodedata.category(chr(c))[0] == "M"
        if on and start is None:
            start = c
        elif not on and start is not None:
            out.append(f"{chr(start)}-{chr(c - 1)}")
            start = None
    return "".join(out)


_W = rf"\w{_marks()}"
_GENDER = {t: g for g, titles in TITLES.items() for t in titles}
_WORD = r"[^\W\d_]+(?:[-’'][^\W\d_]+)*"
_PATTERNS = {
    "email": rf"(?<![{_W}.+-])[{_W}.+-]*[{_W}]@[{_W}][{_W}-]*(?:\.[{_W}-]*[{_W}])+",
    "secret": r"(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b[\"']?\s*[:=]\s*[\"']?)(?P<secret>[A-Za-z0-9_\-+/.]{8,}={0,2})",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.+-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w]|-\d)",
    "phone": r"(?<![\w.])(?:(?:\+1[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\+1[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{4}|\+(?!1\D)\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w|[.-]\d)",
    "person": rf"(?<!\w)(?P<title>{'|'.join(re.escape(t) for t in sorted(_GENDER, key=len, reverse=True))}) (?=[^\W\d_])",
}
_NAME, _POSSESSIVE = re.compile(_WORD), re.compile(r"[’'][sS]$")
#: Numbers that begin like those of card issuers, by length.
_ISSUED = re.compile(r"4\d{12}(?:\d{3})?(?:\d{3})?|5[1-5]\d{14}|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)\d{12}|3[47]\d{13}|3(?:0[0-5]|[68]\d)\d{11}|35\d{14}|6(?:011|4[4-9]\d|5\d\d)\d{12}|(?:5018|5020|5038|6304|6759|676[1-3])\d{9,15}")
#: Lengths of the IBANs of countries.
IBAN_LENGTHS = {c: n for n, cs in {
    15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}.items() for c in cs.split()}
_ANY = re.compile("|".join(f"(?P<k_{k}>{p})" for k, p in _PATTERNS.items()))
#: A text without any of these holds no entity.
_HINT = re.compile(rf"[0-9@]|(?i:token|secret|passw|key)|{'|'.join(re.escape(t) for t in _GENDER)}")


class Stream:
    """Numbers from a key and a label, the same on every machine."""

    def __init__(self, key: bytes, *label: str):
        self.key, self.label, self.n, self.pool = key, "\x1f".join(label).encode("utf-8", "surrogatepass"), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 8:
            self.pool += hmac.new(self.key, self.n.to_bytes(4, "big") + self.label, hashlib.sha256).digest()
            self.n += 1
        x, self.pool = int.from_bytes(self.pool[:8], "big"), self.pool[8:]
        return x * n >> 64

    def of(self, choices: str | tuple):
        return choices[self.below(len(choices))]


def script_of(sign: str) -> str:
    return unicodedata.name(sign, "").partition(" ")[0]


@lru_cache(1 << 14)
def _choices(sign: str) -> str:
    """The other letters of the same script and kind (vowel or consonant) as a lower-case letter; of scripts without an
    alphabet here, those of its category nearby."""
    if letters := ALPHABETS.get(script_of(sign)):
        return "".join(x for x in letters if x != sign and (x in VOWELS) == (sign in VOWELS))
    kind, at = (script_of(sign), unicodedata.category(sign)), ord(sign)
    near = "".join(c for c in map(chr, range(max(0x80, at - 128), min(at + 129, 0x110000))) if c != sign and (script_of(c), unicodedata.category(c)) == kind)
    return near or ALPHABETS["LATIN"]


def _letter(sign: str, s: Stream) -> str:
    """Another letter of the same script, case and kind."""
    low = sign.lower() if len(sign.lower()) == 1 else sign
    got = s.of(_choices(low))
    return got.upper() if sign != low and len(got.upper()) == 1 else got


def _like(text: str, s: Stream) -> str:
    """Letters for letters, digits for digits, all else as it stands."""
    return "".join(str(s.below(10)) if c.isdigit() else _letter(c, s) if c.isalpha() else c for c in text)


def luhn(digits: str) -> bool:
    odd = [int(c) for c in digits[-1::-2]]
    even = [sum(divmod(2 * int(c), 10)) for c in digits[-2::-2]]
    return (sum(odd) + sum(even)) % 10 == 0


def iban_holds(core: str) -> bool:
    return int("".join(str(int(c, 36)) for c in core[4:] + core[:4])) % 97 == 1


def iban_end(text: str, start: int, end: int) -> int:
    """Where the IBAN of a match ends, which may have run on into the next words: at the country's length; of other
    countries and lengths at the longest one that holds. The match's own end if none does."""
    ends = [i + 1 for i in range(start, end) if text[i] != " "]
    whole = [n for n in range(len(ends), 11, -1) if ends[n - 1] == end or not (text[ends[n - 1]].isalnum() or text[ends[n - 1]] == "_")]
    own = IBAN_LENGTHS.get(text[start : start + 2])
    tried = whole if own is None else [n for n in (own, len(ends)) if n in whole]
    return next((ends[n - 1] for n in tried if iban_holds(text[start : ends[n - 1]].replace(" ", ""))), end)


def holds(kind: str, core: str) -> bool:
    """Whether an entity passes its kind's checks: a number that doesn't is not one, and stays."""
    if kind == "card":
        return luhn(core) and _ISSUED.fullmatch(core) is not None
    if kind == "iban":
        return iban_holds(core)
    if kind == "secret":  # a plain word behind "secret:" is none
        return any(c.isdigit() for c in core) or any(c in "_-+/=" for c in core) or core[1:] not in (core[1:].lower(), core[1:].upper())
    if kind == "ssn":
        return core[:3] not in ("000", "666") and core[0] != "9" and core[3:5] != "00" and core[5:] != "0000"
    return True


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _email(core: str, s: Stream, nonce: int, key: bytes) -> str:
    local, _, host = core.rpartition("@")
    labels = host.split(".")
    d = Stream(key, "host", host)  # one host has one surrogate
    lead = [_like(x, d) for x in labels[:-2]] or ([_like(labels[0], d)] if host not in DOMAINS else [])
    name = _like(local, s) + ("" if nonce < NARROW else str(s.below(10**6)))
    return f"{name}@{'.'.join([*lead, d.of(DOMAINS)])}"


def _ip(core: str, s: Stream, nonce: int, key: bytes) -> str:
    spans = {1: (0, 10), 2: (10, 90), 3: (100, 156)}
    parts = [(1, 254) if nonce >= NARROW else spans[len(x)] for x in core.split(".")]
    return ".".join(str(a + s.below(n)) for a, n in parts)


def _card(core: str, s: Stream, nonce: int, key: bytes) -> str:
    """The issuer's digits stay; the last one makes the checksum hold."""
    body = core[:4] + "".join(str(s.below(10)) for _ in core[5:])
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def _phone(core: str, s: Stream, nonce: int, key: bytes) -> str:
    """core: `+` and the country's digits, a blank, the other digits; or those digits alone."""
    lead, _, rest = core.rpartition(" ")
    return f"{lead} " * bool(lead) + str(2 + s.below(8)) + "".join(str(s.below(10)) for _ in rest[1:])


def _ssn(core: str, s: Stream, nonce: int, key: bytes) -> str:
    return "9" + "".join(str(s.below(10)) for _ in core[1:])


def _iban(core: str, s: Stream, nonce: int, key: bytes) -> str:
    body = "".join(str(s.below(10)) if c.isdigit() else chr(65 + s.below(26)) for c in core[4:])
    number = "".join(str(int(c, 36)) for c in body + core[:2]) + "00"
    return f"{core[:2]}{98 - int(number) % 97:02d}{body}"


def _given(core: str, s: Stream, nonce: int, key: bytes) -> str:
    """core: the gender, a blank, the lower-cased name. Later attempts join more names."""
    gender, name = core.split(" ")
    return f"{gender} " + "-".join(s.of(GIVEN[script_of(name[0]), gender]).lower() for _ in range(1 + nonce // 4))


def _family(core: str, s: Stream, nonce: int, key: bytes) -> str:
    return _like(core, s) + ("" if nonce < NARROW else _like(core[-2:], s))


def _initial(core: str, s: Stream, nonce: int, key: bytes) -> str:
    """Another letter for each letter of a script: the next one in an order that the key deals."""
    letters = list(ALPHABETS.get(script_of(core[0]), ""))
    if core[0] not in letters:
        return _letter(core[0], s) + core[1:]
    order, deal = [], Stream(key, "initials", script_of(core[0]))
    while letters:
        order.append(letters.pop(deal.below(len(letters))))
    return order[order.index(core[0]) - 1] + core[1:]


def parts_of(core: str) -> list[tuple[str, str]]:
    """(kind, core) of each word of a person's core: given, family, initial, or as it stands (particle). A part's core is the
    part alone, so that all mentions that have it agree."""
    gender, *names = core.split(" ")
    stay = [n in ACADEMIC or (n in PARTICLES and i + 1 < len(names)) for i, n in enumerate(names)]
    proper = [i for i, n in enumerate(names) if not stay[i]]
    out = []
    for i, n in enumerate(names):
        if stay[i]:
            out.append(("particle", n))
        elif len(n.rstrip(".")) == 1:
            out.append(("initial", n))
        elif i == proper[0] and (len(proper) > 1 or gender[1:]) and (script_of(n[0]), gender[0]) in GIVEN:
            out.append(("given", f"{gender[0]} {n}"))
        else:
            out.append(("family", n))
    return out


def _secret(core: str, s: Stream, nonce: int, key: bytes) -> str:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", core):
        hexa = "0123456789abcdef" if core == core.lower() else "0123456789ABCDEF"
        return "".join(s.of(hexa) for _ in core)
    return _like(core, s)


MAKERS: dict[str, Callable] = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "ssn": _ssn, "card": _card, "phone": _phone, "given": _given, "family": _family, "initial": _initial}


def core_of(kind: str, mention: str, title: str | None = None) -> str:
    """What two mentions of one entity have in common."""
    if kind == "email":
        return mention.lower()
    if kind in ("card", "ssn"):
        return _digits(mention)
    if kind == "phone":
        lead = re.match(r"\+(\d{1,3})(?=\D)", mention)
        return f"+{lead[1]} {_digits(mention[lead.end():])}" if lead else ("+ " if mention[0] == "+" else "") + _digits(mention)
    if kind == "iban":
        return mention.replace(" ", "")
    if kind == "person":
        return f"{_GENDER[title]} {mention.lower()}"  # with a + behind the gender: a given name alone
    return mention


def surrogate(kind: str, core: str, nonce: int, key: bytes) -> str:
    """The surrogate of an entity's core; another one for each nonce."""
    return MAKERS[kind](core, Stream(key, kind, core, str(nonce)), nonce, key)


def dressed(kind: str, mention: str, core: str, new: str) -> str:
    """A surrogate's core in the writing of a mention: its case, its blanks and signs between digits."""
    if kind in ("card", "ssn", "phone"):
        if kind == "phone" and core.startswith("+ "):
            new, core = new[2:], core[2:]
        fresh = iter(_digits(new))
        return "".join(next(fresh) if c.isdigit() else c for c in mention)
    if kind == "iban":
        fresh = iter(new)
        return "".join(next(fresh) if c != " " else c for c in mention)
    if kind == "person":
        old, names = mention.split(" "), new.split(" ")[1:]
        return " ".join(n.upper() if o.isupper() and len(o) > 1 else n.title() if o[0].isupper() else n for o, n in zip(old, names, strict=False))
    if kind == "email" and mention != core:
        return new.upper() if mention == mention.upper() else "".join(n.upper() if i < len(mention) and mention[i].isupper() else n for i, n in enumerate(new))
    return new


def name_end(text: str, at: int) -> int:
    """Where the name at a place ends: capitalised words, initials, and particles and academic titles before them; a
    possessive ending is not part of it, and ends it. The place itself if there is no name."""
    end = start = at
    while m := _NAME.match(text, at):
        word, at = m[0], m.end()
        dot = text[at : at + 1] == "." and (len(word) == 1 or f"{word.lower()}." in ACADEMIC)
        if (cut := _POSSESSIVE.search(word)) and word[0].isupper():
            return m.start() + cut.start()
        at += dot
        if word[0].isupper() and not (dot and len(word) > 1):
            end = at
        elif not dot and word.lower() not in PARTICLES:
            break
        if text[at : at + 1] != " ":
            break
        at += 1
    return end if end > start else start


def entities(text: str) -> Iterator[tuple[str, int, int, str]]:
    """(kind, start, end, core) of each entity of a text, in order. A single name is a given name if it is the first of
    several in another mention with the same form of address, and the last of none. A name of several words that a form
    of address tells is found again without it, and so is its family name."""
    rows = list(_mentions(text))
    if any(kind == "person" for kind, *_ in rows):
        rows = sorted([*rows, *_repeats(text, rows)], key=lambda r: r[1])
    names = [(core.split(" ")[0], parts_of(core)) for kind, _, _, core in rows if kind == "person"]
    given = {c for _, parts in names for k, c in parts if k == "given"}
    family = {c for _, parts in names if len(parts) > 1 for k, c in parts if k == "family"}
    for kind, start, end, core in rows:
        if kind == "person" and core in given and core[2:] not in family:
            core = f"{core[0]}+{core[1:]}"
        yield kind, start, end, core


def _repeats(text: str, rows: list[tuple[str, int, int, str]]) -> Iterator[tuple[str, int, int, str]]:
    """Mentions without a form of address of the persons in rows, outside what rows hold."""
    known: dict[str, str] = {}
    for kind, start, end, core in rows:
        names, words = core.split(" "), text[start:end].split(" ")
        if kind == "person" and len(names) > 2 and len(names) == len(words) + 1:
            known.setdefault(" ".join(words), core)
            if len(words[-1]) > 2:
                known.setdefault(words[-1], f"{names[0]} {names[-1]}")
    if not known:
        return
    taken, i = [(start, end) for _, start, end, _ in rows], 0
    for m in re.finditer(rf"(?<!\w)(?:{'|'.join(re.escape(k) for k in sorted(known, key=len, reverse=True))})(?!\w)", text):
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if i == len(taken) or m.end() <= taken[i][0]:
            yield "person", m.start(), m.end(), known[m[0]]


def _mentions(text: str) -> Iterator[tuple[str, int, int, str]]:
    if not _HINT.search(text):
        return
    at = 0
    while m := _ANY.search(text, at):
        kind = next(k for k in _PATTERNS if m[f"k_{k}"] is not None)
        title = None
        start, end = m.span(f"k_{kind}")
        at = start + 1  # a rejected match may hide an entity that begins inside it
        if kind == "secret":
            start, end = m.span("secret")
        elif kind == "iban":
            end = iban_end(text, start, end)
        elif kind == "person":
            start, title = m.end(), m["title"]
            end = name_end(text, start)
            if start == end or text[start:end].lower() in NOBODY:
                continue
        elif kind == "phone" and not 7 <= len(_digits(text[start:end])) <= 15:
            continue
        core = core_of(kind, text[start:end], title)
        if holds(kind, core):
            yield kind, start, end, core
            at = end


@lru_cache(1 << 16)
def _cached(kind: str, core: str, nonce: int, key: bytes) -> str:
    return surrogate(kind, core, nonce, key)


def _new(kind: str, core: str, nonces: dict[tuple[str, str], int], key: bytes) -> str:
    """The surrogate of an entity; that of a person is made of its parts'."""
    if kind != "person":
        return _cached(kind, core, nonces.get((kind, core), 0), key)
    parts = [c if k == "particle" else _cached(k, c, nonces.get((k, c), 0), key) for k, c in parts_of(core)]
    return " ".join([core.split(" ")[0], *(x.rpartition(" ")[2] for x in parts)])


def replaced(text: str, key: bytes, nonces: dict[tuple[str, str], int] | None = None) -> tuple[str, list[dict]]:
    """The text with surrogates, and where they stand: kind, start and length in the new text."""
    out, at, size, spans = [], 0, 0, []
    for kind, start, end, core in entities(text):
        new = dressed(kind, text[start:end], core, _new(kind, core, nonces or {}, key))
        out += [text[at:start], new]
        size += start - at
        spans.append({"kind": kind, "start": size, "length": len(new)})
        size, at = size + len(new), end
    return ("".join([*out, text[at:]]) if out else text), spans


def found(docs: DataFrame, text: str) -> DataFrame:
    """(h, kind, core) of the entities of texts, once for each hash h of a text, in a written table. Persons are given by
    their given and family names; initials have one surrogate each and need no other attempt."""

    def singly(kind: str, core: str) -> list[tuple[str, str]]:
        return [p for p in parts_of(core) if p[0] in ("given", "family")] if kind == "person" else [(kind, core)]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = {(h, *p) for h, t in zip(b["h"].tolist(), b["text"], strict=True) if isinstance(t, str) for k, _, _, c in entities(t) for p in singly(k, c)}
            yield pd.DataFrame(sorted(rows), columns=["h", "kind", "core"])

    col = F.col(f"`{text}`")
    rows = docs.where(col.isNotNull()).select(F.xxhash64(col).alias("h"), col.alias("text"))
    return written(rows.mapInPandas(each, "h long, kind string, core string").distinct(), "pii-found")


def nonces(cores: DataFrame, key: bytes) -> DataFrame:
    """(kind, core, nonce) such that surrogates of one kind differ from each other and from all real entities.

    Each round keeps the smallest core of those that share a surrogate, and gives the others, and those whose surrogate is
    real, the next nonce, for which theirs alone are made again. It ends when no nonce moves."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(new=[surrogate(k, c, int(n), key) for k, c, n in zip(b["kind"], b["core"], b["nonce"], strict=True)])

    made = lambda rows: rows.select("kind", "core", "nonce").mapInPandas(make, "kind string, core string, nonce int, new string")
    now = written(made(cores.withColumn("nonce", F.lit(0))), "pii-made")
    real = now.select("kind", F.col("core").alias("new"), F.lit(1).alias("real"))
    first = now
    for _ in range(ROUNDS):
        same = now.groupBy("kind", "new").agg(F.min(F.struct("nonce", "core")).alias("first"), F.count(F.lit(1)).alias("k"))
        bad = same.join(real.hint("merge"), ["kind", "new"], "left").where("k > 1 or real is not null")
        move = F.col("k").isNotNull() & (F.col("real").isNotNull() | (F.col("first.core") != F.col("core")))
        seen = now.join(bad.hint("merge"), ["kind", "new"], "left").select("kind", "core", "nonce", "new", F.coalesce(move, F.lit(False)).alias("moved"))
        seen = written(seen, "pii-seen")
        if seen.where("moved").isEmpty():
            return seen.drop("moved")
        again = made(seen.where("moved").withColumn("nonce", F.col("nonce") + 1))
        last, now = now, written(seen.where("not moved").drop("moved").unionByName(again), "pii-made")
        forgotten(seen, *([] if last is first else [last]))
    raise RuntimeError("more entities of a kind than surrogates of its form")


def pseudonymised(docs: DataFrame, text: str = "text", key: bytes = KEY) -> DataFrame:
    """docs with the private data of their texts replaced, and entities (array of kind, start, length in the new text).

    An entity has one surrogate in the whole corpus, made by a keyed hash of its kind and its core, in the writing of each
    mention; the few whose surrogate was taken have another attempt's number, which is joined to the texts that hold
    them. Texts without entities stay as they are; null texts stay null, with no entities. Rows are neither lost nor
    repeated. An input column named entities is replaced. Only the text column is searched."""
    tune(docs.sparkSession)
    seen = found(docs, text)
    taken = written(nonces(seen.select("kind", "core").distinct(), key).where("nonce > 0"), "pii-taken")
    kept = [c for c in docs.columns if c.lower() != "entities"]
    plain = [F.col(f"`{c}`") for c in kept]
    rows = docs.select(F.struct(*plain).alias("row"), F.xxhash64(F.col(f"`{text}`")).alias("h"))
    if taken.isEmpty():
        rows = rows.withColumn("again", F.lit(None).cast("array<struct<kind:string,core:string,nonce:int>>"))
    else:
        again = seen.join(taken, ["kind", "core"]).groupBy("h").agg(F.collect_list(F.struct("kind", "core", "nonce")).alias("again"))
        rows = rows.join(again, "h", "left")

    @F.pandas_udf("text string, entities array<struct<kind:string,start:int,length:int>>")
    def apply(texts: pd.Series, again: pd.Series) -> pd.DataFrame:
        out = []
        for t, a in zip(texts, again, strict=True):
            if not isinstance(t, str):
                out.append((None, []))
                continue
            special = {(x["kind"], x["core"]): int(x["nonce"]) for x in a} if a is not None and not isinstance(a, float) else None
            out.append(replaced(t, key, special))
        return pd.DataFrame(out, columns=["text", "entities"])

    rows = rows.withColumn("new", apply(F.col(f"row.`{text}`"), F.col("again")))
    return rows.select(*[F.col("new.text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in kept], F.col("new.entities").alias("entities"))


def key_of(spark: SparkSession) -> bytes:
    """The session's key of surrogates, from the setting spark.listwright.surrogateKey; that of the tests where it is unset."""
    named = spark.conf.get("spark.listwright.surrogateKey", None)
    return named.encode() if named else KEY


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document with its new text, how many entities it holds and of which kinds. Null texts stay null and
    hold none; repeated ids stay separate rows; no documents give no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = pseudonymised(docs, key=key_of(spark))
    return fewer(out.select("doc_id", "text", F.size("entities").alias("n_entities"), F.concat_ws(",", F.array_sort(F.array_distinct(F.col("entities.kind")))).alias("kinds")))
