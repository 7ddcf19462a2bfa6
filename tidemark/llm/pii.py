"""Personal data by anchor expansion: an Aho-Corasick automaton finds at-signs, plus signs, digits, schemes and identifier cues in
one pass; a parser for each kind of anchor then expands to the boundaries and validates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import parts, two

BASE = ("email", "ip", "card", "phone")
MORE = ("url", "account", "secret")
ORDER = {k: n for n, k in enumerate(BASE + MORE)}
DIGITS = frozenset("0123456789")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
LOCAL = LETTERS | DIGITS | frozenset("._%+-")
LABEL = LETTERS | DIGITS | frozenset("-")
INSIDE = DIGITS | frozenset(" ().-")
WORD = LETTERS | DIGITS | frozenset("_")
SECRET = LETTERS | DIGITS | frozenset("+/=_-")
#: Schemes whose addresses may carry user data, words before account numbers, words before secrets, key prefixes.
SCHEMES = ("http://", "https://", "ftp://", "mailto:", "tel:")
ACCOUNTS = ("iban", "account", "acct", "konto", "compte", "cuenta", "ssn", "passport")
SECRETS = ("password", "passwd", "token", "secret", "api_key", "apikey")
PREFIXES = ("AKIA", "ASIA", "ghp_", "sk_live_")


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in "@+0123456789":
        a.add_word(c, (c if c in "@+" else "0", c))
    for kind, words in (("url", SCHEMES), ("account", ACCOUNTS), ("secret", SECRETS), ("key", PREFIXES)):
        for w in words:
            for form in {w, w.upper(), w.capitalize()} if kind != "key" else {w}:
                a.add_word(form, (kind, form))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban(s: str) -> bool:
    if not (15 <= len(s) <= 34 and s[:2].isalpha() and s[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


class Finder:
    """Spans (kind, start, end) of a text in code points, the end exclusive."""

    def __init__(self):
        self.automaton = automaton()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        if not text:
            return []
        out: list[tuple[str, int, int]] = []
        done = {"email": 0, "ip": 0, "card": 0, "phone": 0, "run": 0, "more": 0, "end": 0, "digit": -1, "letter": -1}
        for last, (kind, form) in self.automaton.iter(text):
            at = last - len(form) + 1
            if kind == "@":
                self._email(text, at, done, out)
            elif kind == "0":
                if at >= done["card"]:
                    self._card(text, at, done, out)
                if at >= done["run"]:
                    self._ip(text, at, done, out)
            elif kind == "+":
                if at >= done["phone"]:
                    self._phone(text, at, done, out)
            else:
                self._cue(text, at, last + 1, kind, done, out)
        return sorted(out, key=lambda x: (x[1], ORDER[x[0]], x[2]))

    @staticmethod
    def _email(t: str, at: int, done: dict, out: list) -> None:
        """Left over the local part, not into the last match; right over labels, of which there are two at least."""
        a = at
        while a > done["email"] and t[a - 1] in LOCAL:
            a -= 1
        b, n, labels = at + 1, len(t), 0
        while True:
            c = b
            while c < n and t[c] in LABEL:
                c += 1
            if c == b:
                b -= labels > 0
                break
            b, labels = c, labels + 1
            if b < n and t[b] == ".":
                b += 1
            else:
                break
        if a < at and labels > 1:
            out.append(("email", a, b))
            done["email"] = b

    @staticmethod
    def _card(t: str, at: int, done: dict, out: list) -> None:
        """Right over digits with at most one blank or hyphen between two."""
        b, n = at + 1, len(t)
        while b < n and (t[b] in DIGITS or (t[b] in " -" and b + 1 < n and t[b + 1] in DIGITS)):
            b += 1
        done["card"] = b
        digits = t[at:b].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", at, b))

    @staticmethod
    def _ip(t: str, at: int, done: dict, out: list) -> None:
        """Right over a chain of numbers with single dots, taken four at a time."""
        b, n, chain, start = at, len(t), [], at
        while True:
            while b < n and t[b] in DIGITS:
                b += 1
            chain.append((start, b))
            if b + 1 < n and t[b] == "." and t[b + 1] in DIGITS:
                b += 1
                start = b
            else:
                break
        done["run"] = b
        for k in range(0, len(chain) - 3, 4):
            four = chain[k : k + 4]
            if all(int(t[x:y]) <= 255 if y - x < 20 else not t[x:y].strip("0")[3:] and int(t[x:y][-20:]) <= 255 and not t[x : y - 20].strip("0") for x, y in four):
                out.append(("ip", four[0][0], four[3][1]))

    @staticmethod
    def _phone(t: str, at: int, done: dict, out: list) -> None:
        """Right over digits, blanks, brackets, dots and hyphens, back to the last digit."""
        b, n = at + 2, len(t)
        if at + 1 >= n or t[at + 1] not in DIGITS:
            return
        while b < n and t[b] in INSIDE:
            b += 1
        while b > at + 2 and t[b - 1] not in DIGITS:
            b -= 1
        if b < at + 4:
            return
        done["phone"] = b
        if 9 <= sum(c in DIGITS for c in t[at:b]) <= 15:
            out.append(("phone", at, b))

    @staticmethod
    def _cue(t: str, at: int, b: int, kind: str, done: dict, out: list) -> None:
        """Addresses with user data, account numbers after a cue (an IBAN by its check digits, others of 6 to 20 digits), secrets after
        a cue and an equals sign or colon, and keys by prefix."""
        n = len(t)
        if at < done["more"] or (at and t[at - 1] in WORD):
            return
        if kind == "url":
            c = b
            while c < n and t[c] > " " and t[c] not in "<>\"'`{}|\\^":
                c += 1
            rest = t[b:c]
            host = rest.split("/", 1)[0]
            if t[at:b].lower() in ("mailto:", "tel:") or "@" in host:
                c -= len(rest) - len(rest.rstrip(".,;:!?)"))
                if c > b:
                    out.append(("url", at, c))
                    done["more"] = c
            return
        if kind == "key":
            c = b
            while c < n and t[c] in WORD:
                c += 1
            if c - b >= 16:
                out.append(("secret", at, c))
                done["more"] = c
            return
        c = b
        while c < n and c - b < 24 and t[c] in " :=#\"'.":
            c += 1
        # Countries' letters may begin like a word between cue and number (NL, NO, IS): an IBAN right after the cue goes first.
        d = Finder._iban(t, c) if kind == "account" and c > b else 0
        if d:
            out.append((kind, c, d))
            done["more"] = d
            return
        while c < n and c - b < 24 and (t[c] in " :=#\"'." or (kind == "account" and t[c] in LETTERS and t[b:c].strip(" :#.").lower() + t[c].lower() in CONNECT)):
            c += 1
        if c == b or (kind == "secret" and not ("=" in t[b:c] or ":" in t[b:c])):
            return
        if kind == "secret":
            if c >= done["end"]:
                # A run with many cues is read once: its end, and its last digit and letter.
                d = c
                while d < n and t[d] in SECRET:
                    if t[d] in DIGITS:
                        done["digit"] = d
                    elif t[d] in LETTERS:
                        done["letter"] = d
                    d += 1
                done["end"] = d
            d = done["end"] if done["end"] - c >= 8 and done["digit"] >= c and done["letter"] >= c else c
        else:
            d = Finder._iban(t, c) or Finder._number(t, c)
        if d > c:
            out.append((kind, c, d))
            done["more"] = d

    @staticmethod
    def _iban(t: str, c: int) -> int:
        """End of the longest IBAN from c on: groups of letters or digits, parted by a blank or hyphens; 0 if none passes its check digits."""
        d, n, flat, end = c, len(t), "", 0
        while d < n and len(flat) < 34:
            if t[d] in LETTERS or t[d] in DIGITS:
                flat += t[d].upper()
                if len(flat) >= 15 and not (d + 1 < n and (t[d + 1] in LETTERS or t[d + 1] in DIGITS)) and iban(flat):
                    end = d + 1
            elif not flat or not (t[d] == "-" or (t[d] == " " and t[d - 1] != " ")):
                break
            d += 1
        return end

    @staticmethod
    def _number(t: str, c: int) -> int:
        """End of 6 to 20 digits from c on, with hyphens or blanks before digits between; 0 if there aren't, or if letters join them."""
        d, n, digits, end = c, len(t), 0, 0
        while d < n and digits <= 20:
            if t[d] in DIGITS:
                digits, end = digits + 1, d + 1
            elif t[d] in LETTERS:
                return 0
            elif not (t[d] == "-" or (t[d] == " " and d + 1 < n and t[d + 1] in DIGITS)):
                break
            d += 1
        return end if 6 <= digits <= 20 else 0


#: What may stand between a cue and the number, with every beginning of it.
CONNECT = {w[:k] for w in ("no", "nr", "num", "number", "id", "is") for k in range(1, len(w) + 1)}


def told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of each row.

    Null and empty texts have no spans and the digest of the empty string. Spans of different kinds may overlap, those of one kind
    don't. Rows with repeated or null ids each give a row. Columns other than the two named are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for ids, texts in parts(batches):
            found = [finder.spans(t) for t in texts]
            base = [[s for s in x if s[0] in BASE] for x in found]
            counts = [pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in BASE]
            digest = pa.array([hashlib.sha256(told(x).encode()).hexdigest() for x in base])
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *counts, digest, pa.array([told(x) for x in found], pa.string())], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return two(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the name of its first kind in brackets."""
    out, at = [], 0
    for k, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with personal data in text_col replaced; null stays null, all other columns stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            texts = [None if t is None else masked(t, finder.spans(t)) for t in batch.column(k).to_pylist()]
            yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema)


def masked_documents(docs: DataFrame) -> DataFrame:
    """mask_pii for a table of documents: n_chars follows the text."""
    return mask_pii(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
