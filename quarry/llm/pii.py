"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss.

The patterns' spans are always kept. Where digits, spelled-out addresses or keys
stand, the field scores whole candidate spans (digit groups, checksums, separators, cue
words before them, and what borders on them) and dynamic programming over spans
of bounded length chooses boundaries and types together (Sarawagi and Cohen,
2004). It is trained here, on sentences made from templates, by the gradient of
the exact log-likelihood over all segmentations.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import slices, text_of

KINDS = ("email", "ip", "card", "phone")
#: What the field can add: the patterns' kinds, and keys or passwords.
ALL_KINDS = (*KINDS, "secret")

# The base patterns. A domain is matched where an @ stands, digits of an address from a group's start.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Per kind, the leftmost non-overlapping matches that pass the kind's check."""
    ip = [m.span() for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    card = [m.span() for m in CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    phone = [m.span() for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return {"email": emails(text), "ip": ip, "card": card, "phone": phone}


# ---- the field

#: Tokens of a candidate span, at most: the bound of the dynamic programming.
MOST_TOKENS = 26
#: No number of any kind has more digits.
MOST_DIGITS = 19
#: A run of key characters with a letter and a digit is one token.
OPAQUE = re.compile(r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*[0-9])(?=[0-9_]*[A-Za-z])[A-Za-z0-9_]{12,}")
TOKENS = re.compile(OPAQUE.pattern + r"|[A-Za-z]+|[0-9]+|\s+|.", re.S)
RUN = re.compile(r"[0-9][0-9 ()./\[\]\-]{5,}[0-9]")
AT = re.compile(r" ?[\[({] ?(?:at|AT|At) ?[\])}] ?| (?:at|AT|At) ")
SPELLED = re.compile(r"[A-Za-z0-9-]++(?:(?: ?[\[({] ?(?:dot|DOT|Dot) ?[\])}] ?| (?:dot|DOT|Dot) |\.)[A-Za-z0-9-]++)++")
DOT_LABEL = re.compile(r"(?: ?[\[({] ?(?:dot|DOT|Dot) ?[\])}] ?| (?:dot|DOT|Dot) |\.)[A-Za-z0-9-]")
SECRET = re.compile(r"[A-Za-z0-9_+/\-]{12,}={0,2}")
CUES = {
    "phone": "phone call ring tel telephone fax mobile cell dial number portable telefon teléfono téléphone".split(),
    "card": "card visa mastercard amex credit karte tarjeta carte payment".split(),
    "email": "mail email contact write reach correo".split(),
    "ip": "ip host server address login client".split(),
    "secret": "token secret password passwd pwd key apikey auth bearer passwort clave credential credentials".split(),
}
FEATURES = (
    "one", "d<8", "d8", "d9-12", "d13-15", "d16-19", "d>19", "luhn", "quads", "quads<256", "+", "00", "0", "(", "at", "dot", "slash", "round", "square", "blank", "hyphen", "point", "fours", "one group",
    "cue email", "cue ip", "cue card", "cue phone", "cue secret", "left glued", "right glued", "date", "words", "edge", "key", "key>20", "key and cue", "assigned", "hex", "upper and lower", "no digit", "slashes",
    "3-3-4", "pairs", "one separator", "digit before", "digit follows", "dot follows", "phone-like groups",
)


def span_features(text: str, start: int, end: int) -> list[int]:
    """The numbers of the features that text[start:end] has as a span."""
    s = text[start:end]
    groups = re.findall(r"[0-9]+", s)
    d = "".join(groups)
    low = s.lower()
    words = re.findall(r"[a-z]+", low)
    before = re.findall(r"[^\W_]+", text[max(0, start - 24) : start].lower())[-3:]
    sizes = [len(g) for g in groups]
    is_key = bool(SECRET.fullmatch(s)) and bool(re.search(r"[A-Za-z]", s))
    cue = any(w in CUES["secret"] for w in before)
    left, right = text[start - 1 : start], text[end : end + 1]
    n = len(d)
    has = {
        "one": True,
        "d<8": n < 8, "d8": n == 8, "d9-12": 9 <= n <= 12, "d13-15": 13 <= n <= 15, "d16-19": 16 <= n <= 19, "d>19": n > 19,
        "luhn": 13 <= n <= 19 and luhn(d),
        "quads": len(groups) == 4 and not words,
        "quads<256": len(groups) == 4 and not words and all(len(g) <= 3 and int(g) <= 255 for g in groups) and "." in s,
        "+": s[0] == "+", "00": s.startswith("00"), "0": s[0] == "0" and not s.startswith("00"), "(": s[0] == "(",
        "at": "at" in words, "dot": "dot" in words,
        "slash": "/" in s, "round": "(" in s or ")" in s, "square": "[" in s or "]" in s, "blank": " " in s, "hyphen": "-" in s, "point": "." in s,
        "fours": len(groups) >= 3 and all(len(g) == 4 for g in groups[:-1]),
        "one group": len(groups) == 1 and n == len(s),
        "left glued": bool(left) and (left.isalnum() or left in "._-/@"), "right glued": bool(right) and (right.isalnum() or right in "@/_"),
        "date": bool(re.search(r"(?:19|20)[0-9]{2}[-/.][01]?[0-9][-/.][0-3]?[0-9]", s)),
        "words": bool(words) and not ({"at", "dot"} & set(words)),
        "key": is_key, "key>20": is_key and len(s) > 20, "key and cue": is_key and cue, "assigned": is_key and bool(re.search(r"[=:]\s*[\"']?$", text[max(0, start - 4) : start])),
        "hex": is_key and not re.search(r"[^0-9a-fA-F]", s), "upper and lower": is_key and low != s and s.upper() != s, "no digit": is_key and not n, "slashes": is_key and s.count("/") > 1,
        "3-3-4": sizes[-3:] == [3, 3, 4], "pairs": len(sizes) > 3 and not set(sizes[1:]) - {2}, "one separator": len(sizes) > 1 and len(set(re.findall(r"[^0-9]+", s.strip("+()")))) == 1,
        "digit before": bool(re.search(r"[0-9][ .\-/]?$", text[max(0, start - 2) : start])), "digit follows": bool(re.match(r"[ .\-/]?[0-9]", text[end : end + 2])),
        "dot follows": bool(DOT_LABEL.match(text, end)), "phone-like groups": 2 <= len(sizes) <= 5 and max(sizes) <= 8 and min(sizes) > 1,
        "edge": bool(re.match(r"(?:at|dot)\b", low)) or bool(re.search(r"\b(?:at|dot)$", low)),
    } | {f"cue {k}": any(w in CUES[k] for w in before) for k in ALL_KINDS}
    return [i for i, f in enumerate(FEATURES) if has[f]]


def candidates(text: str, start: int, end: int) -> tuple[list[int], list[tuple[int, int, list[int]]]]:
    """Token boundaries of a zone, and (first, last boundary, features) of the spans that can be entities."""
    keys = dict(m.span() for m in SECRET.finditer(text, start, end) if re.search(r"[A-Za-z]", m[0]))
    bounds = [start, *(m.end() for m in TOKENS.finditer(text, start, end))]
    pieces = [text[a:z] for a, z in zip(bounds, bounds[1:], strict=False)]
    digits = [sum("0" <= c <= "9" for c in x) for x in pieces]
    letters = [bool(re.search(r"[^\W\d]", x)) for x in pieces]
    ats = [x.lower() == "at" for x in pieces]
    spans = []
    for i, piece in enumerate(pieces):
        if not (piece[0].isalnum() or piece[0] in "+("):
            continue
        n, groups, word, at = 0, 0, False, False
        for j in range(i + 1, min(i + MOST_TOKENS, len(pieces)) + 1):
            n, groups, word, at = n + digits[j - 1], groups + (digits[j - 1] > 0), word or letters[j - 1], at or ats[j - 1]
            if n > MOST_DIGITS and not at:
                break
            if pieces[j - 1][0].isalnum() and ((7 <= n <= MOST_DIGITS or groups == 4 <= n) and not word or at and re.search(r"\bat\b.*(?:\bdot\b|\.)", text[bounds[i] : bounds[j]].lower())):
                spans.append((i, j, span_features(text, bounds[i], bounds[j])))
    place = {b: i for i, b in enumerate(bounds)}
    spans += [(place[a], place[b], span_features(text, a, b)) for a, b in keys.items() if a in place and b in place]
    return bounds, spans


def zones(text: str) -> list[tuple[int, int]]:
    """Stretches where an entity beyond the patterns can stand, as long as they are: digits, spelled addresses, and keys.

    Only spans are bounded (MOST_TOKENS; a key is one), so the work grows with a zone's length.
    """
    found = [m.span() for m in RUN.finditer(text)]
    for m in AT.finditer(text):
        left = m.start()
        while left and text[left - 1] in LOCAL:
            left -= 1
        if left < m.start() and (right := SPELLED.match(text, m.end())):
            found.append((left, right.end()))
    found += [m.span() for m in SECRET.finditer(text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) or re.search(r"[=:]\s?[\"']?$", text[max(0, m.start() - 4) : m.start()])]
    out: list[list[int]] = []
    for a, b in sorted(found):
        a, b = max(0, a - 2), min(len(text), b + 2)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def decode(text: str, zone: tuple[int, int], weights: np.ndarray) -> list[tuple[str, int, int]]:
    """The best segmentation of a zone: tokens outside cost nothing, spans score their features."""
    bounds, spans = candidates(text, *zone)
    if not spans:
        return []
    by_end: dict[int, list] = {}
    for i, j, f in spans:
        scores = weights[:, f].sum(1)
        k = int(scores.argmax())
        by_end.setdefault(j, []).append((i, k, scores[k]))
    best, back = [0.0], [None]
    for j in range(1, len(bounds)):
        top, how = best[j - 1], None
        for i, k, s in by_end.get(j, ()):
            if best[i] + s > top:
                top, how = best[i] + s, (i, k)
        best.append(top)
        back.append(how)
    out, j = [], len(bounds) - 1
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            i, k = back[j]
            out.append((ALL_KINDS[k], bounds[i], bounds[j]))
            j = i
    return out[::-1]


def _sentence(r: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A sentence and its entities, made from templates."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(3, 9)))

    def card():
        body = r.choice("3456") + d(r.choice((12, 14, 14, 15)))
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = r.choice((".", "/", "  ", " - ", "", " ", "-"))
        return sep.join(body[i : i + 4] for i in range(0, len(body), 4))

    def email():
        at, dot = r.choice(((" at ", " dot "), ("[at]", "[dot]"), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" (at) ", "."), ("[at]", "."), (" AT ", " DOT ")))
        return word() + r.choice(("", "." + word(), d(2))) + at + "".join(word() + dot for _ in range(r.choice((1, 1, 2)))) + r.choice(("com", "org", "net", "de"))

    def phone():
        sep = r.choice((" ", "-", ".", "/"))
        national = (f"({d(3)}) {d(3)}-{d(4)}", f"(0{d(2)}) {d(4)}-{d(4)}", f"0{d(3)}{r.choice('/ -')}{d(7)}", f"0{d(2)}{sep}{d(3)}{sep}{d(4)}", f"0{d(3)}{sep}{d(3)}{sep}{d(4)}", f"0{d(1)}{sep}{d(2)}{sep}{d(2)}{sep}{d(2)}{sep}{d(2)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}")
        return r.choice((f"00{r.choice(('49', '33', '34', '1'))}{sep}{d(3)}{sep}{d(3)}{sep}{d(4)}", f"00{r.choice(('49', '44', '1'))} {d(2)} {d(7)}", f"00{r.choice(('49', '44', '33'))}{sep}{d(2)}{sep}{d(3)}{sep}{d(4)}", *national))

    def ip():
        return r.choice(("[.]", "(.)", " . ", "[.]")).join(str(r.randint(0, 255)) for _ in range(4))

    def nothing():
        return r.choice((f"{d(4)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d} {d(2)}", d(r.randint(7, 30)), f"{d(2)} {d(2)} {d(2)} {d(2)}", f"{word()} at {word()}. {word()}", f"{d(3)}.{d(3)}.{d(2)}", f"{d(5)}/{d(4)}", f"20{d(2)}/{r.randint(1, 12)}/{r.randint(1, 28)} {d(3)}", f"{word()} dot {word()}", f"{word()}{d(9)}", f"{d(1)}.{d(2)}.{d(3)}.{d(4)}.{d(2)}", " ".join(d(3) for _ in range(r.randint(4, 8))), " ".join(d(r.randint(1, 3)) for _ in range(6))))

    text, spans = word(), []
    for _ in range(r.randint(1, 2)):
        kind = r.choice(("card", "email", "phone", "ip", None, None))
        if kind and r.random() < 0.6:
            text += " " + r.choice(CUES[kind]) + r.choice(("", ":"))
        start = len(text) + 1
        text += " " + {"card": card, "email": email, "phone": phone, "ip": ip, None: nothing}[kind]()
        if kind:
            spans.append((kind, start, len(text)))
        while kind == "phone" and r.random() < 0.3:  # a list
            text += r.choice((" ", ", "))
            spans.append((kind, len(text), len(text) + len(more := phone())))
            text += more
        text += r.choice((" ", ", ", ". ")) + word()
    return text, spans


def _key_sentence(r: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """As _sentence, with a key or password, or with what only looks like one."""
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    word = lambda: pick("abcdefghilmnoprstu", r.randint(3, 9))
    key = r.choice((lambda: pick("0123456789abcdef", r.choice((32, 40, 64))), lambda: "AKIA" + pick(lower.upper() + digits, 16), lambda: "ghp_" + pick(lower + lower.upper() + digits, 36), lambda: pick(lower + lower.upper() + digits + "+/_-", r.randint(20, 44)) + "7a", lambda: "sk-" + pick(lower + digits, 32)))()
    if r.random() < 0.55:
        before = r.choice(CUES["secret"]) + r.choice((" = ", "=", ": ", ' = "', '="', " "))
        text = f"{word()} {r.choice(('', 'api_', 'my '))}{before}"
        return f"{text}{key}{chr(34) if before.endswith(chr(34)) else ''} {word()}", [("secret", len(text), len(text) + len(key))]
    plain = r.choice((lambda: pick("0123456789abcdef", 40), lambda: f"{word()}/{word()}/{word()}/{word()}{r.randint(1, 99)}", lambda: pick(lower, r.randint(12, 24)), lambda: f"{word()}-{word()}-{word()}", lambda: f"{word()}{word()}{pick(digits, 4)}", lambda: f"{pick('0123456789abcdef', 8)}-{pick('0123456789abcdef', 4)}-{pick('0123456789abcdef', 4)}-{pick('0123456789abcdef', 12)}"))()
    return f"{word()} {r.choice(('commit', 'see', 'file', 'id', word(), word() + ':'))} {plain} {word()}", []


@lru_cache(maxsize=1)
def trained(sentences: int = 900, rounds: int = 50, rate: float = 0.5, ridge: float = 0.002) -> np.ndarray:
    """weights[kind, feature], from the exact gradient of the segmentations' log-likelihood. The same every time."""
    r, data = random.Random(7), []
    for i in range(sentences):
        text, gold = _key_sentence(r) if i % 4 == 0 else _sentence(r)
        bounds, spans = candidates(text, 0, len(text))
        place = {b: i for i, b in enumerate(bounds)}
        want = {(place.get(a), place.get(b)): ALL_KINDS.index(k) for k, a, b in gold}
        matrix = np.zeros((len(spans), len(FEATURES)))
        for row, (_, _, f) in enumerate(spans):
            matrix[row, f] = 1
        truth = np.zeros((len(spans), len(ALL_KINDS)))
        for row, (i, j, _) in enumerate(spans):
            if (i, j) in want:
                truth[row, want[i, j]] = 1
        data.append((len(bounds), [(i, j) for i, j, _ in spans], matrix, truth))
    w, grown = np.zeros((len(ALL_KINDS), len(FEATURES))), np.full((len(ALL_KINDS), len(FEATURES)), 1e-8)
    for _ in range(rounds):
        grad = -ridge * sentences * w
        for n, ends, matrix, truth in data:
            if not ends:
                continue
            s = np.clip(matrix @ w.T, -30, 30)
            e = np.exp(s)
            both = e.sum(1)
            ahead, behind = [1.0] + [0.0] * (n - 1), [0.0] * (n - 1) + [1.0]
            into: dict[int, list] = {}
            outof: dict[int, list] = {}
            for row, (i, j) in enumerate(ends):
                into.setdefault(j, []).append((i, both[row]))
                outof.setdefault(i, []).append((j, both[row]))
            for j in range(1, n):
                ahead[j] = ahead[j - 1] + sum(ahead[i] * x for i, x in into.get(j, ()))
            for i in range(n - 2, -1, -1):
                behind[i] = behind[i + 1] + sum(behind[j] * x for j, x in outof.get(i, ()))
            reach = np.array([ahead[i] * behind[j] for i, j in ends]) / ahead[-1]
            grad += (truth - e * reach[:, None]).T @ matrix
        grown += grad**2
        w += rate * grad / np.sqrt(grown)
    return w


def all_spans(text: str, weights: np.ndarray) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[int, int, int]]]:
    """The base spans, and (kind number, start, end) of those with what the field adds beside them."""
    base = base_spans(text)
    spans = [(k, a, b) for k, kind in enumerate(KINDS) for a, b in base[kind]]
    taken = sorted((a, b) for _, a, b in spans)
    for zone in zones(text):
        over = [t for t in taken if t[0] < zone[1] and t[1] > zone[0]]
        for kind, a, b in decode(text, zone, weights):
            if not any(x < b and y > a for x, y in over):
                spans.append((ALL_KINDS.index(kind), a, b))
    return base, sorted(spans)


def _joined(spans) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    docs needs doc_id and text; other columns are ignored. Null texts are empty.
    The counts and base_sha256 are of the patterns' spans; spans lists these and
    what the field adds, which never overlaps them: more of the four kinds, and
    secrets (keys and passwords). Positions are code points,
    ends exclusive. Whole texts are read; repeated rows give repeated results and
    an empty table none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches):
        for whole in batches:
            for b in slices(whole):
                out: list[list] = [[] for _ in range(7)]
                for text in b.column("text").to_pylist():
                    base, spans = all_spans(text, shared.value)
                    only = [(k, x, y) for k, kind in enumerate(KINDS) for x, y in base[kind]]
                    digest = hashlib.sha256(_joined(only).encode()).hexdigest()
                    for col, v in zip(out, (*(len(base[k]) for k in KINDS), digest, _joined(spans), len(spans) - len(only)), strict=True):
                        col.append(v)
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(v, t) for v, t in zip(out, kinds, strict=True))], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    rows = docs.select("doc_id", text_of().alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
