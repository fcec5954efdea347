"""Personal data: keyed surrogates of the same type, script and format, the same for every mention, never shared by two.

Entities are found by one pattern. Each distinct one, in a normal form without case and separators, gets a surrogate from
a keyed hash: letters become letters of their script (vowels vowels, consonants consonants), digits digits, given names
given names of their gender. A corpus-wide check sends entities whose surrogates meet each other, or another entity, to
further attempts until all differ. The surrogates are then fitted into each mention's own case and separators.

Names are found where a title or a known given name stands before capitals (initials, particles, hyphens, apostrophes and
further names may follow, and the whole may be written in capitals), after salutations, signatures and the like, and by
patronymics and Greek endings. A run of capitals ends at words that are no names, such as Street. Every word of a found
name, the given, middle and last ones, is an entity of its own, and is then replaced wherever else it stands in the same
document. Card numbers, IBANs and ISBNs are told from other numbers by their check digits, which surrogates keep right.

Only documents with an entity are shuffled; all others pass through.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlume.llm.common import Scratch, stage

#: Given names by script and gender, and titles: fixed values of the detector and the pool of its surrogates.
GIVEN = {
    ("latin", "f"): [
        "Alice", "Amanda", "Angela", "Anna", "Barbara", "Caroline", "Charlotte", "Christine", "Claire", "Deborah", "Diana", "Elena", "Elizabeth", "Emily", "Emma", "Fiona", "Hannah", "Helen",
        "Isabella", "Jane", "Jennifer", "Jessica", "Julia", "Karen", "Katherine", "Laura", "Linda", "Lisa", "Lucy", "Margaret", "Maria", "Mary", "Michelle", "Monika", "Nancy", "Natalie", "Olivia",
        "Patricia", "Priya", "Rachel", "Rebecca", "Samantha", "Sandra", "Sarah", "Sophie", "Susan", "Victoria",
        "Aisha", "Brenda", "Carmen", "Chiara", "Fatima", "Giulia", "Ingrid", "Lucia", "Mei", "Olga", "Petra", "Sabine", "Tatiana", "Yuki",
    ],
    ("latin", "m"): [
        "Alexander", "Andrew", "Anthony", "Benjamin", "Brian", "Bob", "Carlos", "Charles", "Christopher", "Daniel", "David", "Edward", "Eric", "Frederick", "George", "Gregory", "Hans", "Henry", "Jack",
        "James", "Jason", "Jean", "John", "Jonathan", "Joseph", "Juan", "Kevin", "Lawrence", "Lukas", "Mark", "Martin", "Matthew", "Michael", "Nicholas", "Patrick", "Paul", "Peter", "Pierre", "Richard",
        "Robert", "Samuel", "Simon", "Stephen", "Steven", "Thomas", "Timothy", "William",
        "Ahmed", "Ali", "Antonio", "Diego", "Giovanni", "Hassan", "Hiroshi", "Ivan", "Jorge", "Jose", "Klaus", "Luis", "Mohammed", "Omar", "Pablo", "Rajesh", "Stefan", "Wei", "Wolfgang",
    ],
    ("cyrillic", "f"): ["Анастасия", "Виктория", "Екатерина", "Марина", "Наталья", "Светлана", "Анна", "Елена", "Мария", "Ольга"],
    ("cyrillic", "m"): ["Александр", "Дмитрий", "Константин", "Михаил", "Николай", "Сергей", "Алексей", "Владимир", "Иван", "Пётр"],
    ("greek", "f"): ["Αικατερίνη", "Βασιλική", "Δήμητρα", "Ελένη", "Μαρία", "Σοφία"],
    ("greek", "m"): ["Αλέξανδρος", "Γεώργιος", "Δημήτριος", "Κωνσταντίνος", "Γιώργος", "Νίκος"],
}
TITLES = ["Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Sra"]
PARTICLES = ["van der", "von der", "de la", "van", "von", "de", "da", "del", "di", "bin", "al"]

#: Capitalised words that end a name, and words before a name.
NO_NAMES = [
    "Street", "Avenue", "Road", "Lane", "Drive", "Boulevard", "Square", "Park", "Bridge", "Station", "Airport", "University", "College", "School", "Institute", "Hospital", "Church", "Museum", "Library",
    "Foundation", "Company", "Corporation", "Corp", "Inc", "Ltd", "LLC", "Bank", "Group", "Club", "Award", "Prize", "County", "City", "State", "River", "Lake", "Mountain", "Mount", "Island", "Bay", "Valley",
    "Center", "Centre", "Hall", "House", "Hotel", "Straße", "Platz", "Allee", "Universität", "Prime", "Minister", "President", "King", "Queen", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday",
    "Sunday", "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December", "The", "And", "But", "In", "On", "At", "Of", "To", "By", "Is", "It", "He",
    "She", "We", "They", "This", "That", "Day", "Act", "War", "North", "South", "East", "West", "New", "Team", "All", "Sir", "Madam", "Customer",
]
BEFORE_NAMES = ["dear", "met", "contact", "signed", "sincerely", "regards", "wishes", "name is", "name", "attn", "author", "patient", "i am", "i'm"]

NAMES = "|".join(n for names in GIVEN.values() for n in names)
END = r"(?![\p{L}\p{N}])"
WORD = rf"(?!(?:{'|'.join(NO_NAMES)}){END})(?:\p{{Lu}}['’]|Mc|Mac)?\p{{Lu}}\p{{Ll}}+(?:-\p{{Lu}}\p{{Ll}}+)*{END}"
LOUD = rf"(?!(?:{'|'.join(NO_NAMES).upper()}){END})(?:\p{{Lu}}['’])?\p{{Lu}}{{2,}}(?:-\p{{Lu}}{{2,}})*{END}"
BETWEEN = rf"(?: (?:\p{{Lu}}[.]|{'|'.join(PARTICLES)})){{0,3}}"
REST = rf"(?:{BETWEEN} {WORD}){{1,4}}"
CYRILLIC = r"\p{Lu}[а-яё]+(?:-\p{Lu}[а-яё]+)?"
NAME = r"(?<![\p{L}\p{N}])(?:" + "|".join([
    rf"(?=\p{{Lu}})(?:{'|'.join(TITLES)})[.]?{REST}",
    rf"(?=\p{{Lu}})(?:{NAMES})(?:-\p{{Lu}}\p{{Ll}}+)?{REST}",
    rf"(?=\p{{Lu}}{{2}})(?:{NAMES.upper()})(?:{BETWEEN} {LOUD}){{1,3}}",
    rf"(?=\p{{Lu}}[а-яё]){CYRILLIC}(?: {CYRILLIC})? \p{{Lu}}[а-яё]+(?:ович|евич|ьич|овна|евна|ична){END}(?: {CYRILLIC})?",
    r"(?=\p{Lu}\p{InGREEK})\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}*(?:όπουλος|οπούλου|άκης|άκη|ίδης|ίδου|άδης|άδου)" + END,
    rf"(?=\p{{Lu}})(?<=(?<![\p{{L}}\p{{N}}])(?i:{'|'.join(BEFORE_NAMES)}),?:?[ \n]{{1,2}}){WORD}{REST}",
    rf"(?=\p{{Ll}})(?<=(?i:my name is ))(?:{NAMES.lower()}) \p{{Ll}}{{2,}}{END}",
]) + ")"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_][\p{L}\p{N}._%+-]{0,63}@(?:[\p{L}\p{N}][\p{L}\p{N}-]*[.])+\p{L}{2,24}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = rf"(?<![0-9.])(?:{OCTET}[.]){{3}}{OCTET}(?![0-9]|[.][0-9])"
SECRET = r"""(?<![\p{L}\p{N}_-])(?=[\p{L}\p{N}_-]{16})(?<=(?i:token|secret|key|password)["']? ?[=:] ?["']?)[\p{L}\p{N}_-]{16,}"""
KEYS = r"(?<![\p{L}\p{N}_-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,255}|xox[abprs]-[A-Za-z0-9-]{10,255}|sk-[A-Za-z0-9_-]{20,255})(?![\p{L}\p{N}_-])"
SAID = r"""(?<=(?<![\p{L}\p{N}])(?i:password|passcode|token|secret) is ?:? ?["']?)(?=[^\s"',;]*[0-9])[\p{L}\p{N}_#$%&*+!-]{8,}"""
IPV6 = r"(?<![\p{L}\p{N}:.])(?=[0-9a-fA-F:]*[0-9])(?=[0-9a-fA-F:]*[0-9a-fA-F]::?[0-9a-fA-F])(?=[0-9a-fA-F]{0,4}(?::[0-9a-fA-F]{1,4})*::|(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F])[0-9a-fA-F]{0,4}(?::[0-9a-fA-F]{0,4}){2,7}(?![\p{L}\p{N}:])"
MAC = r"(?<![\p{L}\p{N}:-])[0-9a-fA-F]{2}(?:[:-][0-9a-fA-F]{2}){5}(?![\p{L}\p{N}:-])"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
PHONE_00 = r"(?<![0-9\p{L}.,-])00[1-9][0-9]{0,2}(?:[ .-][0-9]{1,8}){2,5}(?![0-9])"  # before cards, as it may have as many digits
PHONE = "|".join([
    r"(?<![0-9\p{L}])(?:[+][0-9]{1,3}[ .-]?)?(?:[(][0-9]{2,4}[)] ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])",
    r"(?<![0-9\p{L}])[+][0-9]{8,15}(?![0-9])",
    r"(?<![0-9\p{L}])[+][0-9]{1,3}(?:[ .-][0-9]{1,8}){2,5}(?![0-9])",
    r"(?<![0-9\p{L}.,-])0[0-9](?: [0-9]{2}){4}(?! ?[0-9])",
    r"(?<![0-9\p{L}.,-])01[5-7][0-9][ /-]?[0-9]{7,8}(?![0-9])",
    r"(?<![0-9\p{L}.,-])0[1-9][0-9]{1,3}[ /-][0-9]{5,8}(?![0-9.,-])",
])
ENTITY = "|".join([EMAIL, KEYS, SECRET, SAID, IBAN, MAC, IPV6, IP, SSN, PHONE_00, CARD, PHONE, NAME])
SEPARATORS = " .-()"

VOWELS = {"latin": "aeiou", "cyrillic": "аеиоуыэюя", "greek": "αεηιουω"}
CONSONANTS = {"latin": "bcdfghjklmnpqrstvwxyz", "cyrillic": "бвгджзйклмнпрстфхцчшщ", "greek": "βγδζθκλμνξπρστφχψ"}
MARKED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
TONED = "άέήίόύώ"
HAN = "安白春大东方光海和华江金林美明南平清山石水天文西小新星雪阳玉"


def kind_of(surface: Column) -> Column:
    """The type of what the pattern found, from its text alone; null for numbers whose check digits say that they are none."""
    bare = F.translate(surface, SEPARATORS, "")
    iban = surface.rlike(r"^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?$")
    long = surface.rlike("^[0-9 -]+$") & F.char_length(bare).between(13, 19) & ~surface.rlike("^00[1-9]")
    isbn = bare.rlike("^97[89][0-9]{10}$")
    return (
        F.when(surface.contains("@"), "email")
        .when(surface.rlike(rf"^(?:{OCTET}[.]){{3}}{OCTET}$"), "ip")
        .when(iban, F.when(mod97(F.lower(bare)) == 1, "iban"))
        .when(surface.rlike("^[0-9a-fA-F]{2}(?:[:-][0-9a-fA-F]{2}){5}$"), "mac")
        .when(surface.rlike("^[0-9a-fA-F:]+$") & surface.contains(":"), "ip")
        .when(surface.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(long, F.when((luhn(bare) == 0) & ~isbn, "card"))
        .when(surface.rlike("^[0-9+() ./-]+$"), "phone")
        .when(surface.contains(" "), "name")
        .otherwise("secret")
    )


def normal(surface: Column, kind: Column) -> Column:
    """What all mentions of an entity share: no case, no separators where they carry nothing. Names are taken word by word.

    A phone number is known by its last nine digits, so that it is one with and without its country code.
    """
    bare = F.translate(surface, SEPARATORS + ":", "")
    digits = F.regexp_replace(surface, "[^0-9]", "")
    phone = F.when(F.char_length(digits) > 9, F.substr(digits, F.char_length(digits) - 8)).otherwise(digits)
    return F.lower(F.when(kind == "phone", phone).when(kind.isin("iban", "ssn", "card", "mac"), bare).otherwise(surface))


def mod97(iban: Column) -> Column:
    """The remainder that tells a right IBAN, 1, of its lower-case form without spaces."""

    def add(s: Column, c: Column) -> Column:
        letter = F.ascii(c) - 87
        return F.when(c.between("0", "9"), (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + letter) % 97)

    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda s, c: F.when(c == "", s).otherwise(add(s, c)))


def digits_sixteen(text: Column, stream: Column) -> Column:
    """Hexadecimal digits become others, all else stays."""
    one = lambda c, i: F.when(c.rlike("[0-9a-f]"), F.substr(stream, i % 128 + 1, F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.split(text, ""), one), "")


def hashed(key: str, *parts: Column) -> Column:
    """128 hexadecimal digits that depend on the key and the parts."""
    text = F.concat_ws("\x1f", *parts)
    return F.concat(*[F.sha2(F.concat(F.lit(f"{key}\x1e{i}\x1e"), F.sha2(F.concat(F.lit(f"{i}\x1e{key}\x1e"), text), 256)), 256) for i in (0, 1)])


def pick(pool: str, v: Column) -> Column:
    return F.substr(F.lit(pool), v % len(pool) + 1, F.lit(1))


def scrambled(text: Column, stream: Column, keep: Column) -> Column:
    """Each character after the first keep ones becomes one of its kind: digits digits, letters letters of their script."""

    def one(c: Column, i: Column) -> Column:
        v = F.conv(F.substr(stream, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int") + (i / 64).cast("int")
        out = F.when(i < keep, c).when(c.between("0", "9"), pick("0123456789", v))
        for script in VOWELS:
            out = out.when(F.instr(F.lit(VOWELS[script]), c) > 0, pick(VOWELS[script], v)).when(F.instr(F.lit(CONSONANTS[script]), c) > 0, pick(CONSONANTS[script], v))
        out = out.when(F.instr(F.lit(TONED), c) > 0, pick(TONED, v)).when(c == "ς", c)  # the latter stands at ends alone
        return out.when(F.instr(F.lit(MARKED), c) > 0, pick(MARKED, v)).when(c.rlike(r"\p{IsHan}"), pick(HAN, v)).when(c.rlike(r"\p{L}"), pick("xzqj", v)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10."""

    def add(s: Column, c: Column) -> Column:
        d = c.cast("int") * F.when(s["double"], 2).otherwise(1)
        return F.struct((s["sum"] + F.when(d > 9, d - 9).otherwise(d)).alias("sum"), (~s["double"]).alias("double"))

    return F.aggregate(F.reverse(F.split(digits, "")), F.struct(F.lit(0).alias("sum"), F.lit(False).alias("double")), add, lambda s: s["sum"] % 10)


def surrogate(kind: Column, entity: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a normal form at an attempt. Of attempts beyond 16, every further 16 add a character, so that one is free in the end."""
    stream = hashed(key, kind, entity, attempt.cast("string"))
    octet = lambda i: F.conv(F.substr(stream, F.lit(2 * i + 1), F.lit(2)), 16, 10)
    private = F.regexp_extract(entity, r"^(?:10|127|192[.]168|172[.](?:1[6-9]|2[0-9]|3[01]))[.]", 0)
    kept = F.size(F.split(private, r"[.]")) - 1
    ip = F.concat(private, F.array_join(F.slice(F.array(*[octet(i) for i in range(4)]), kept + 1, F.lit(4)), "."))
    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    top = F.substring_index(domain, ".", -1)
    place = F.substr(domain, F.lit(1), F.char_length(domain) - F.char_length(top))
    email = F.concat(scrambled(local, stream, F.lit(0)), F.lit("@"), scrambled(place, hashed(key, F.lit("domain"), domain), F.lit(0)), top)
    body = scrambled(F.substr(entity, F.lit(1), F.char_length(entity) - 1), stream, F.lit(1))
    # the last digit keeps the card as valid, or as invalid, as it was
    card = F.concat(body, F.pmod(luhn(entity) - luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
    keep = F.when((kind == "secret") & entity.rlike("^(?:akia|asia|gh[pousr]_|xox[abprs])"), 4).when((kind == "secret") & entity.rlike("^sk-"), 3).otherwise(0)
    account = F.concat(F.substr(entity, F.lit(1), F.lit(2)), F.lit("00"), scrambled(F.substr(entity, F.lit(5)), stream, F.lit(0)))
    iban = F.concat(F.substr(account, F.lit(1), F.lit(2)), F.lpad((98 - mod97(account)).cast("string"), 2, "0"), F.substr(account, F.lit(5)))
    hexadecimal = F.substr(F.repeat(stream, F.ceil(F.char_length(entity) / 128).cast("int")), F.lit(1), F.char_length(entity))
    out = F.when((kind == "secret") & entity.rlike("^[0-9a-f]+$"), hexadecimal).when(kind == "email", email).when((kind == "mac") | entity.contains(":") & (kind == "ip"), digits_sixteen(entity, stream)).when(kind == "ip", ip).when(kind == "card", card).when(kind == "iban", iban).otherwise(scrambled(entity, stream, keep))
    more = F.substr(hashed(key, F.lit("more"), entity, attempt.cast("string")), F.lit(1), F.floor((attempt - 1) / 16).cast("int"))
    more = F.when(kind.isin("mac") | entity.contains(":"), more).when(kind.isin("name", "email", "secret"), F.translate(more, "0123456789", "ghijklmnop")).otherwise(F.translate(more, "abcdef", "012345"))
    # before the @, so that the domain stays
    longer = F.when(kind == "email", F.concat(F.substring_index(out, "@", 1), more, F.lit("@"), F.substring_index(out, "@", -1))).otherwise(F.concat(out, more))
    return F.when(attempt <= 16, out).otherwise(longer)


def assign(entities: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(kind, entity, surrogate) for distinct (kind, entity): no surrogate twice within a kind, and none that is an entity.

    Of the entities that meet in a surrogate, the first in order keeps it and the others try again; usually one round is
    all. What is decided and what is open is written between rounds.
    """
    known = entities.select("kind", F.col("entity").alias("surrogate"))
    decided, waiting, attempt = None, entities, 0
    while True:
        tried = waiting.withColumn("surrogate", surrogate(F.col("kind"), F.col("entity"), F.lit(attempt), key))
        winners = tried.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity"))
        winners = winners.join(known, ["kind", "surrogate"], "left_anti")
        if decided is not None:
            winners = winners.join(decided.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = scratch.stage(winners.select("kind", "entity", "surrogate"), "surrogates")
        decided = won if decided is None else decided.unionByName(won)
        waiting = scratch.stage(waiting.join(won, ["kind", "entity"], "left_anti"), "waiting")
        if waiting.limit(1).count() == 0:
            return decided
        attempt += 1


def given_names(key: str) -> dict[str, str]:
    """A keyed permutation of the given names of each script and gender without fixed points."""
    out = {}
    for names in GIVEN.values():
        ring = sorted(names, key=lambda n: hashlib.sha256(f"{key}\x1f{n}".encode()).hexdigest())
        out |= dict(zip(ring, ring[1:] + ring[:1], strict=True))
    return out


def fitted(surface: Column, kind: Column, replacement: Column) -> Column:
    """The surrogate in the mention's own case and separators."""
    separators = SEPARATORS + ":"
    separate = kind.isin("iban", "ssn", "card", "phone", "mac")
    country = F.when(kind == "phone", F.greatest(F.lit(0), F.char_length(F.regexp_replace(surface, "[^0-9]", "")) - 9)).otherwise(0)

    def one(c: Column, i: Column) -> Column:
        before = F.substr(surface, F.lit(1), i)
        place = F.when(kind == "phone", F.char_length(F.regexp_replace(before, "[^0-9]", "")) - country).when(separate, F.char_length(F.translate(before, separators, ""))).otherwise(i)
        p = F.substr(replacement, place + 1, F.lit(1))
        same = (separate & (F.instr(F.lit(separators), c) > 0)) | ((kind == "phone") & (~c.between("0", "9") | (place < 0)))
        return F.when(same, c).when(c.rlike(r"\p{Lu}"), F.upper(p)).otherwise(p)

    used = F.when(kind == "phone", F.char_length(F.regexp_replace(surface, "[^0-9]", "")) - country).when(separate, F.char_length(F.translate(surface, separators, ""))).otherwise(F.char_length(surface))
    plain = F.concat(F.array_join(F.transform(F.split(surface, ""), one), ""), F.substr(replacement, used + 1))
    # of an IBAN with digits alone behind its country nothing tells its case; its surrogate's letters are capitals
    return F.when((kind == "ip") & surface.contains("."), replacement).when(surface == F.upper(surface), F.upper(plain)).otherwise(plain)


class Names:
    """The words of names: which are given names, which stay, and what they become."""

    def __init__(self, key: str):
        pairs = [x for a, b in given_names(key).items() for x in (a, b)]
        self.swap = F.create_map(*[F.lit(x) for x in [*pairs, *(x.upper() for x in pairs), *(x.lower() for x in pairs)]])
        stay = [*TITLES, *(w for p in PARTICLES for w in p.split(" "))]
        self.stay = F.array(*[F.lit(w) for w in dict.fromkeys(stay)])

    def stays(self, word: Column) -> Column:
        return F.array_contains(self.stay, F.rtrim(word, F.lit("."))) | word.rlike(r"^\p{Lu}[.]$")

    def given(self, word: Column) -> Column:
        """Another given name, in each part of a hyphenated one that is one; null where none is."""
        parts = F.split(word, "-")
        known = F.exists(parts, lambda x: F.try_element_at(self.swap, x).isNotNull())
        return F.when(known, F.array_join(F.transform(parts, lambda x: F.coalesce(F.try_element_at(self.swap, x), x)), "-"))

    def others(self, surface: Column) -> Column:
        """The words that are neither."""
        return F.filter(F.split(surface, " "), lambda w: ~self.stays(w) & self.given(w).isNull())

    def new_word(self, word: Column, surrogates: Column) -> Column:
        """What a word of a name becomes, given the surrogates by lower-case word."""
        found = F.try_element_at(surrogates, F.lower(word))
        fit = F.when((word == F.upper(word)) & (F.char_length(word) > 1), F.upper(found)).when(word == F.lower(word), found).otherwise(F.initcap(found))
        return F.when(self.stays(word), word).otherwise(F.coalesce(self.given(word), fit, word))

    def pairs(self, surface: Column, surrogates: Column) -> Column:
        """(old, new) for the words of a name, as they are written and in their plain and loud forms."""
        words = F.filter(F.split(surface, " "), lambda w: ~self.stays(w))
        forms = lambda f: F.transform(words, lambda w: F.struct(f(w).alias("old"), self.new_word(f(w), surrogates).alias("new")))
        as_is = lambda w: w
        return F.array_distinct(F.concat(forms(as_is), forms(F.upper), forms(F.initcap)))


def replaced_words(text: Column, pairs: Column) -> Column:
    """The text with each old word that stands alone made the new one."""
    pattern = lambda w: F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), w, F.lit(r"\E(?![\p{L}\p{N}])"))
    return F.aggregate(pairs, text, lambda t, p: F.when(F.contains(t, p["old"]), F.regexp_replace(t, pattern(p["old"]), p["new"])).otherwise(t))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of docs has."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def replace_pii(docs: DataFrame, key: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text replaced, and n_entities and kinds (distinct types, sorted, joined by commas) added.

    All columns of docs are kept, whatever their names; only n_entities and kinds are overwritten. Texts without entities
    stay as they are; null texts stay null with 0 entities. Mentions of one entity get one surrogate in all documents,
    repeated rows are replaced each, an empty table gives an empty one, texts of any length are taken whole. n_entities
    counts what the pattern finds, without the further mentions of names' words. Titles, particles and initials stay.
    """
    docs = docs.drop("n_entities", "kinds")
    found, row, swap, kinds, bare = fresh(docs, "pii_found", "pii_row", "pii_swap", "pii_kinds", "pii_bare")
    text, names = F.col(text_col), Names(key)
    worth = text.rlike("[0-9@]") | text.rlike(NAME) | text.rlike(SECRET) | text.rlike(KEYS)
    marked = docs.withColumn(found, F.when(worth, F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))))
    some = F.coalesce(F.size(found) > 0, F.lit(False))
    clean = marked.filter(~some).drop(found).withColumns({"n_entities": F.lit(0).cast("bigint"), "kinds": F.lit("")})
    hit = stage(marked.filter(some).withColumn(row, F.struct(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("d"), F.xxhash64(text).alias("t"))), "entities")

    with Scratch(docs.sparkSession) as scratch:
        mentions = hit.select(F.col(row).alias("row"), F.explode(F.array_distinct(found)).alias("surface")).distinct()
        mentions = mentions.withColumn("kind", kind_of(F.col("surface"))).filter("kind IS NOT NULL")
        of_names = F.transform(names.others(F.col("surface")), lambda w: F.lower(w))
        entity = F.when(F.col("kind") == "name", of_names).otherwise(F.array(normal(F.col("surface"), F.col("kind"))))
        mentions = scratch.stage(mentions.withColumn("entity", F.explode_outer(entity)), "mentions")  # written, as one entity may be named in a great many rows: Spark can split these
        decided = assign(scratch.stage(mentions.filter("entity IS NOT NULL").select("kind", "entity").distinct(), "entities"), key, scratch)
        fits = scratch.stage(mentions.join(decided, ["kind", "entity"], "left"), "fits")
        plain = fits.filter("kind <> 'name'").select("row", "kind", "surface", fitted(F.col("surface"), F.col("kind"), F.col("surrogate")).alias("new"), F.array().cast("array<struct<old:string,new:string>>").alias("pairs"))
        words = fits.filter("kind = 'name'").groupBy("row", "kind", "surface").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.when(F.col("entity").isNotNull(), F.struct("entity", "surrogate"))))).alias("w"))
        name = F.array_join(F.transform(F.split("surface", " "), lambda x: names.new_word(x, F.col("w"))), " ")
        named = words.select("row", "kind", "surface", name.alias("new"), names.pairs(F.col("surface"), F.col("w")).alias("pairs"))
        of_row = plain.unionByName(named).groupBy("row").agg(
            F.map_from_entries(F.collect_list(F.struct("surface", "new"))).alias(swap), F.array_sort(F.collect_set("kind")).alias(kinds), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias(bare),
        )
        of_row = stage(of_row.withColumnRenamed("row", row), "swaps")

    joined = hit.join(of_row, row, "left").drop(row).withColumn(bare, F.coalesce(bare, F.array().cast("array<struct<old:string,new:string>>")))
    known = F.coalesce(F.col(swap), F.create_map().cast("map<string,string>"))
    gaps = F.transform(F.split(text, ENTITY, -1), lambda g: replaced_words(g, F.col(bare)))
    new = F.array_join(F.zip_with(gaps, F.transform(found, lambda e: F.coalesce(F.try_element_at(known, e), e)), lambda g, e: F.concat(g, F.coalesce(e, F.lit("")))), "")
    count = F.size(F.filter(found, lambda e: F.try_element_at(known, e).isNotNull())).cast("bigint")
    replaced = joined.withColumns({"n_entities": count, "kinds": F.coalesce(F.array_join(kinds, ","), F.lit("")), text_col: new})
    return replaced.select(clean.columns).unionByName(clean)
