"""Personal data replaced by surrogates (operator 3).

``detect`` finds e-mail addresses, phone, card and social security numbers, IBANs,
IP addresses, secrets (values of password-like assignments, access keys) and
names (behind a form of address, or a common given name with a surname).  A name's
parts, however many, are entities of their own, so "Mr Smith" and "John Smith" stay
related; particles ("de la", "von") stay, an initial becomes another initial of the
script's basic letters (other letters stay).

Each distinct entity (kind and canonical form) of the whole table gets one
surrogate, drawn by HMAC from a key: of the same kind, with the original's length
and signs, a card's check digit kept right or wrong, names in the script and for
the gender of the original.  In rounds over the entity table, a draw that is an
entity of the table itself, or that another entity has, is drawn anew for all but
one, until none is left; so different entities stay different and equal ones
equal, wherever they occur.  Rendering puts a surrogate into each mention's own
writing (separators, case).

Defined cases: null texts stay null; texts without entities stay as they are; rows
that repeat are replaced alike; extra columns pass through; an empty table stays
empty.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatch.session import materialize

from .common import free_name, in_arrow, table

# Forms of address, with the gender they tell (m, f or n: none).
ADDRESS = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mademoiselle": "f",
    "Señora": "f", "Señorita": "f", "Sra": "f", "Doña": "f", "Dr": "n", "Prof": "n", "Professor": "n",
    "господин": "m", "Господин": "m", "госпожа": "f", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f",
}
# Common given names by script and gender; also the first choice of surrogates.
GIVEN = {
    ("latin", "m"): "James John Robert Michael William David Richard Thomas Charles Daniel Matthew Anthony Hans Klaus Jürgen "
                    "Wolfgang Stefan Pierre Jacques François Philippe Carlos Miguel Javier Alejandro".split(),
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Margaret Emily Ursula Monika "
                    "Sabine Heike Nathalie Isabelle Sylvie Brigitte Carmen Lucía Pilar Dolores Mercedes".split(),
    ("latin", "n"): "Robin Jordan Morgan Taylor Casey Riley Quinn Dominique Camille Claude Sascha Kim".split(),
    ("cyrillic", "m"): "Иван Дмитрий Сергей Алексей Николай Михаил Владимир Андрей Павел Борис".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Людмила".split(),
    ("greek", "m"): "Γιώργος Γιάννης Κώστας Δημήτρης Νίκος Παναγιώτης".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Βασιλική Σοφία Αγγελική".split(),
}
# Syllables for surrogates beyond the given names, and for surnames.
SYLLABLES = {
    "latin": "bar bel bran cal cor dal den dor el fal fen gar gil hal hart ken lan len lor mar mel nor pal per ran ros sal sel "
             "tan tor val ver wal wen win".split(),
    "cyrillic": "бар бел бор вал вер гор дан дол зар зим кар кол лад лен лес мал мир нов пол рад род сав сол тар тих яр".split(),
    "greek": "αλ βασ γαλ δελ ζαφ θαλ καλ λαμ μαρ ναυ παλ ραπ σαρ ταμ φιλ χαρ".split(),
}
GIVEN_ENDS = {("latin", "m"): "ard o ian us".split(), ("latin", "f"): "a ine ella ia".split(), ("latin", "n"): "y is en".split(),
              ("cyrillic", "m"): "ий ан ей".split(), ("cyrillic", "f"): "а ия ина".split(), ("cyrillic", "n"): "а ий".split(),
              ("greek", "m"): "ος ης ας".split(), ("greek", "f"): "α η ία".split(), ("greek", "n"): "α ος".split()}
SURNAME_ENDS = {("latin", "n"): "ford ton man er well ley".split(), ("cyrillic", "m"): "ов ин ский".split(),
                ("cyrillic", "f"): "ова ина ская".split(), ("greek", "n"): "ίδης άκης όπουλος".split(), ("greek", "f"): "ίδου άκη οπούλου".split()}
ALPHABETS = {"LATIN": "abcdefghijklmnopqrstuvwxyz", "CYRILLIC": "абвгдежзиклмнопрстуфхцчшэюя", "GREEK": "αβγδεζηθικλμνξοπρστυφχψω"}

# Small words inside a name, and those that only follow such a word; they stay.
PARTICLES = set("de del della di da do dos du van von vom bin ibn af av ter ten".split())
BEHIND_PARTICLES = set("la las los le les der den dem het".split())

WORD = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
EMAIL = re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
CARD = re.compile(r"(?<![\w.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{5})(?![\d.]*\w)")
IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d|\w)")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
PHONE = re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}"
                   r"|\(\d{2,4}\) ?\d{3,4}[ .-]\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)")
SECRET = re.compile(r"(?i)(?<![^\W_])(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key)[\"']?\s*[:=]\s*[\"']?"
                    r"([A-Za-z0-9+/_.=~-]{6,})")
ACCESS_KEY = re.compile(r"(?<!\w)(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w)|(?<!\w)(?:ghp_|sk-)[A-Za-z0-9]{20,}(?!\w)")
NAME_WORD = re.compile(WORD)
_automata: list = []


def _starts() -> ahocorasick.Automaton:
    """Finds where names may begin: forms of address and given names, as written or in capitals."""
    if not _automata:
        a = ahocorasick.Automaton()
        for w, gender in ADDRESS.items():
            for x in {w, w.upper()}:
                a.add_word(x, (x, "", gender))
        for (script, gender), names in GIVEN.items():
            for w in names:
                for x in {w, w.upper()}:
                    a.add_word(x, (x, script, gender))
        a.make_automaton()
        _automata.append(a)
    return _automata[0]


def script_of(word: str) -> str:
    name = unicodedata.name(word[0], "")
    return "cyrillic" if name.startswith("CYRILLIC") else "greek" if name.startswith("GREEK") else "latin" if name.startswith("LATIN") else ""


def _surname_kind(script: str, gender: str, word: str) -> str:
    if script == "cyrillic":
        gender = "f" if word[-1:].lower() in "ая" else "m"
    elif script == "greek":
        gender = "f" if gender == "f" else "n"
    else:
        gender = "n"
    return f"surname {script} {gender}"


def _names(text: str) -> Iterator[tuple[int, int, str, str]]:
    done = 0
    for end, (word, script, gender) in _starts().iter(text):
        at = end - len(word) + 1
        if at < done or at and (text[at - 1].isalnum() or text[at - 1] in "_'-") or text[end + 1:end + 2].isalnum():
            continue
        nxt = end + 1
        if not script:
            nxt += text[nxt:nxt + 1] == "."
            if text[nxt:nxt + 1] != " ":
                continue
            at, nxt = nxt + 1, nxt + 1
        words = []          # (start, end, word, what it is besides a name)
        place = at
        while m := NAME_WORD.match(text, place):
            w, what = m[0], "initial" if len(m[0]) == 1 else ""
            if w == w.lower() or w.isupper() and word.isupper():
                if w.lower() in PARTICLES or words and words[-1][3] == "particle" and w.lower() in BEHIND_PARTICLES:
                    what = "particle"
            if what != "particle" and not (w[0].isupper() and script_of(w)):
                break
            if words and script_of(w) != script_of(words[0][2]) or not what and w.isupper() != word.isupper():
                break
            words.append((m.start(), m.end(), w, what))
            stop = what == "initial" and text[m.end():m.end() + 1] == "."
            place = m.end() + stop
            if text[place:place + 1] == " ":
                place += 1
            elif not stop:          # initials may stand close, as in J.F. Kennedy
                break
        while words and words[-1][3]:
            words.pop()
        # a given name alone is no person
        if not words or script and len(words) < 2:
            continue
        kind_of = script_of(words[0][2])
        for i, (a, b, w, what) in enumerate(words):
            if what == "particle":
                continue
            if what == "initial":
                kind = f"initial {kind_of}"
            elif i == len(words) - 1:
                kind = _surname_kind(kind_of, gender, w)
            else:
                known = next((g for (s, g), ns in GIVEN.items() if s == kind_of and w.title() in ns), gender)
                kind = f"given {kind_of} {known}"
            for part in re.finditer(r"[^\W\d_]+", w):
                yield a + part.start(), a + part.end(), kind, part[0].lower()
        done = words[-1][1]


def detect(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of the entities, in order and apart."""
    if not text:
        return []
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0].lower()) for m in EMAIL.finditer(text)]
    if "=" in text or ":" in text:
        found += [(m.start(1), m.end(1), "secret", m[1]) for m in SECRET.finditer(text)]
    if re.search(r"\d", text):
        found += [(m.start(), m.end(), "secret", m[0]) for m in ACCESS_KEY.finditer(text)]
        found += [(m.start(), m.end(), "iban", m[0].replace(" ", "")) for m in IBAN.finditer(text)]
        found += [(m.start(), m.end(), "card", re.sub(r"\D", "", m[0])) for m in CARD.finditer(text)]
        found += [(m.start(), m.end(), "ip", m[0]) for m in IP.finditer(text)]
        found += [(m.start(), m.end(), "ssn", re.sub(r"\D", "", m[0])) for m in SSN.finditer(text)]
        found += [(m.start(), m.end(), "phone", re.sub(r"[^+\d]", "", m[0])) for m in PHONE.finditer(text)]
    found += _names(text)
    order = {k: i for i, k in enumerate("email secret iban card ip ssn phone".split())}
    found.sort(key=lambda x: (x[0], order.get(x[2], 99), -x[1]))
    apart: list[tuple[int, int, str, str]] = []
    for x in found:
        if apart and x[0] < apart[-1][1]:
            if order.get(x[2], 99) < order.get(apart[-1][2], 99):
                apart[-1] = x
            continue
        apart.append(x)
    return apart


class _Draw:
    """Numbers from an HMAC of what they are for."""

    def __init__(self, key: bytes, *what: object):
        self.key, self.what, self.n, self.pool = key, "\x00".join(map(str, what)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool = hmac.new(self.key, self.what + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.n += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x % n

    def of(self, xs):
        return xs[self.below(len(xs))]

    def like(self, c: str) -> str:
        """A character of the same class."""
        if c.isdigit():
            return str(self.below(10))
        if c.isalpha():
            x = self.of(ALPHABETS.get(unicodedata.name(c, "").split(" ")[0], ALPHABETS["LATIN"]))
            return x.upper() if c.isupper() else x
        return c


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def surrogate(key: bytes, kind: str, canon: str, attempt: int) -> str:
    """The canonical form drawn for an entity; after many attempts it grows longer, so that draws never run out."""
    d = _Draw(key, kind, canon, attempt)
    extra = attempt // 8
    sort, *rest = kind.split(" ")
    if sort == "initial":       # one cycle through the alphabet, so that equal stays equal and different different
        letters = list(ALPHABETS[rest[0].upper()])
        of_script = _Draw(key, kind)
        for i in range(len(letters) - 1, 0, -1):
            j = of_script.below(i + 1)
            letters[i], letters[j] = letters[j], letters[i]
        return letters[(letters.index(canon) + 1) % len(letters)] if canon in letters else canon
    if sort in ("given", "surname"):
        script, gender = rest
        if sort == "given" and attempt < 4 and (script, gender) in GIVEN:
            return d.of(GIVEN[script, gender]).lower()
        ends = GIVEN_ENDS if sort == "given" else SURNAME_ENDS
        ends = ends.get((script, gender)) or ends[script, "n" if (script, "n") in ends else "m"]
        return "".join(d.of(SYLLABLES[script]) for _ in range(1 + (sort == "surname") + d.below(2) + extra)) + d.of(ends)
    if sort == "domain":
        name, _, top = canon.rpartition(".")
        return "".join(map(d.like, name)) + "".join(str(d.below(10)) for _ in range(extra)) + "." + top
    if sort == "email":
        local, _, domain = canon.rpartition("@")
        return "".join(map(d.like, local)) + "".join(str(d.below(10)) for _ in range(extra)) + "@" + surrogate(key, "domain", domain, 0)
    if sort == "ip":
        a, b, *_ = map(int, canon.split("."))
        if a in (10, 127) or (a, b) == (192, 168) or a == 172 and 16 <= b < 32:
            # a private one; of a block that is used up, one of the largest private block, then any
            head = [[a] if a in (10, 127) else [a, b], [10], []][min(extra, 2)]
        else:
            head = [d.of([x for x in range(1, 224) if x not in (10, 127, 172, 192)])]
        head = head or [1 + d.below(223)]
        return ".".join(map(str, head + [d.below(256) for _ in range(4 - len(head))]))
    if sort == "iban":
        return canon[:2] + "".join(map(d.like, canon[2:])) + "".join(str(d.below(10)) for _ in range(extra))
    if sort == "secret":
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", canon):
            hexes = "0123456789abcdef" if canon == canon.lower() else "0123456789ABCDEF"
            return "".join(d.of(hexes) for _ in range(len(canon) + extra))
        head = re.match(r"AKIA|ASIA|ghp_|sk-|", canon)[0]
        return head + "".join(map(d.like, canon[len(head):])) + "".join(str(d.below(10)) for _ in range(extra))
    keep = {"card": 1, "ssn": 0}.get(sort, (2 if canon[1:2] in "17" else 3) if canon.startswith("+") else 0)
    out = canon[:keep] + "".join(str(d.below(10)) for _ in canon[keep:]) + "".join(str(d.below(10)) for _ in range(extra))
    if sort == "ssn":
        out = str(1 + d.below(6)) + str(1 + d.below(5)) + out[2:]
    if sort == "card":
        right = next(c for c in "0123456789" if luhn(out[:-1] + c))
        out = out[:-1] + (right if luhn(canon) else str((int(right) + 1 + d.below(9)) % 10))
    return out


def render(mention: str, kind: str, new: str) -> str:
    """A surrogate in the writing of a mention."""
    if kind.startswith(("given", "surname", "initial")):
        return new.upper() if mention.isupper() and len(mention) > 1 else new.title() if mention[:1].isupper() else new
    if kind == "email":
        return new.upper() if mention.isupper() else new
    if kind in ("card", "ssn", "phone", "iban"):
        left = iter(new)
        return "".join(next(left) if c.isalnum() or c == "+" else c for c in mention) + "".join(left)
    return new


def mentions(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(__id, __k1, __k2, start, stop, kind, canon) of every entity found."""
    t = F.col(f"`{text}`")
    given = df.select(F.col(f"`{doc_id}`").alias("__id"), F.xxhash64(t).alias("__k1"), F.xxhash64(F.lit(1), t).alias("__k2"), t.cast("string").alias("t"))
    kind = given.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, t in enumerate(batch.column(3).to_pylist()):
                got = detect(t)
                rows += [i] * len(got)
                found += got
            at = pa.array(rows, pa.int64())
            cols = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).take(at) for k in range(3)] + [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()),
                                                                pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())],
                names=["__id", "__k1", "__k2", "start", "stop", "kind", "canon"])

    return in_arrow(given, run, f"__id {kind}, __k1 long, __k2 long, start int, stop int, kind string, canon string")


def one_gender(found: DataFrame) -> DataFrame:
    """Mentions of a name have one kind: of the genders told with it anywhere the most frequent, if any is.

    So Mr Alex Smith and Dr Alex Smith get one surrogate.
    """
    part = F.split("kind", " ")
    names = found.where("kind RLIKE '^(given|surname) '").select(F.get(part, F.lit(0)).alias("sort"), F.get(part, F.lit(1)).alias("script"), "canon", F.get(part, F.lit(2)).alias("gender"))
    told = names.groupBy("sort", "script", "canon", "gender").agg(F.count(F.lit(1)).alias("n"))
    several = (told.groupBy("sort", "script", "canon")
               .agg(F.max_by("gender", F.struct(F.col("gender") != "n", "n", "gender")).alias("gender"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
               .select("sort", "script", F.col("canon").alias("name"), "gender"))
    j = found.withColumn("part", part).join(several, (F.get("part", F.lit(0)) == several["sort"]) & (F.get("part", F.lit(1)) == several["script"])
                                            & (found["canon"] == several["name"]), "left")
    kind = F.when(F.col("name").isNull(), F.col("kind")).otherwise(F.concat_ws(" ", "sort", "script", "gender"))
    return j.select(*[kind.alias("kind") if c == "kind" else F.col(c) for c in found.columns])


def _drawn(rows: DataFrame, key: bytes, attempt: int) -> DataFrame:
    """(kind, canon, new) of rows (kind, canon, domain): a draw each; an address gets the domain given."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [surrogate(key, k, c, attempt) for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            new = [x if d is None else x.rpartition("@")[0] + "@" + d for x, d in zip(new, b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(new, pa.string())], names=["kind", "canon", "new"])
    return in_arrow(rows.select("kind", "canon", "domain"), run, "kind string, canon string, new string")


def _settled(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, new) for entities (kind, canon, domain); none of two kinds that are written alike share a draw."""
    alike = F.when(F.col("kind").rlike("^(given|surname) "), F.lit("name")).otherwise(F.col("kind"))
    taken = entities.select(alike.alias("alike"), F.col("canon").alias("new"))
    settled, todo, attempt = None, entities, 0
    while not todo.isEmpty():
        drawn = materialize(_drawn(todo, key, attempt).withColumn("alike", alike), "drawn")
        # of the entities that drew the same, the first in order has it, if no entity is it and none had it before
        free = drawn.groupBy("alike", "new").agg(F.min(F.struct("kind", "canon")).alias("x")).join(taken, ["alike", "new"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("alike", "new"), ["alike", "new"], "left_anti")
        free = materialize(free.select("x.kind", "x.canon", "new", "alike"), "settled")
        settled = free if settled is None else settled.unionByName(free)
        todo = materialize(todo.join(free.select("kind", "canon"), ["kind", "canon"], "left_anti"), "todo")
        attempt += 1
    return (entities.withColumn("new", F.lit("")).limit(0) if settled is None else settled).select("kind", "canon", "new")


def surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, new): a surrogate of its own for each distinct (kind, canon), and one for each mail domain."""
    none = F.lit(None).cast("string")
    entities = materialize(entities.select("kind", "canon").distinct().withColumn("domain", none), "entities")
    # an alphabet is too small for draws that are no entity: initials have their place in a keyed cycle
    initials = _drawn(entities.where("kind LIKE 'initial %'"), key, 0)
    domain = F.substring_index("canon", "@", -1)
    mail = F.col("kind") == "email"
    domains = entities.where(mail).select(F.lit("domain").alias("kind"), domain.alias("canon"), "domain").distinct()
    rest = _settled(entities.where(~mail & ~F.col("kind").startswith("initial ")).unionByName(domains), key)
    new_domain = rest.where("kind = 'domain'").select(F.col("canon").alias("of"), F.col("new").alias("domain"))
    mails = entities.where(mail).drop("domain").join(new_domain, domain == F.col("of")).select("kind", "canon", "domain")
    return rest.where("kind <> 'domain'").unionByName(_settled(materialize(mails, "mails"), key)).unionByName(initials)


def replace_entities(df: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text", replaced: str | None = None) -> DataFrame:
    """``df`` with surrogates in ``text``; ``replaced`` names a column for the number of entities."""
    found = one_gender(materialize(mentions(df, doc_id, text), "mentions"))
    new = surrogates(found, key)
    i, a, b, spans_name = (free_name(df, x) for x in ("id_", "h1_", "h2_", "spans_"))
    spans = (found.join(new, ["kind", "canon"]).groupBy("__id", "__k1", "__k2")
             .agg(F.array_sort(F.collect_set(F.struct("start", "stop", "kind", "new"))).alias("spans")))
    spans = spans.select(F.col("__id").alias(i), F.col("__k1").alias(a), F.col("__k2").alias(b), F.col("spans").alias(spans_name))
    keep = [c for c in df.columns if c != replaced]
    t = df[f"`{text}`"]
    same = df[f"`{doc_id}`"].eqNullSafe(spans[i]) & (F.xxhash64(t) == spans[a]) & (F.xxhash64(F.lit(1), t) == spans[b])
    joined = df.join(spans, same, "left").select(*[df[f"`{c}`"] for c in keep], spans_name)
    at = keep.index(text)
    out = [*keep, replaced] if replaced else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans_ = b.column(at).to_pylist(), b.column(len(keep)).to_pylist()
            done = []
            for t, xs in zip(texts, spans_):
                if xs:
                    parts, last = [], 0
                    for x in xs:
                        parts += [t[last:x["start"]], render(t[x["start"]:x["stop"]], x["kind"], x["new"])]
                        last = x["stop"]
                    t = "".join(parts) + t[last:]
                done.append(t)
            cols = [*b.columns[:at], pa.array(done, pa.string()), *b.columns[at + 1:len(keep)]]
            if replaced:
                cols.append(pa.array([len(x or ()) for x in spans_], pa.int32()))
            yield pa.RecordBatch.from_arrays(cols, names=out)

    fields = [f"`{c}` {'string' if c == text else df.schema[c].dataType.simpleString()}" for c in keep]
    return in_arrow(joined, run, ", ".join(fields + ([f"`{replaced}` int"] if replaced else [])))


KEY = b"surrogates of the registered query"     # an own secret key for real use


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY, replaced="replaced")
