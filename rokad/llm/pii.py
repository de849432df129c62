"""Surrogates for personal data and credentials, with DataFrame functions only.

1. One pass over the texts finds candidates of all kinds with one pattern. Kinds with a rule beyond their form (card check digit) are checked.
2. Entities are brought to a normal form (digits of a phone, lower-cased address), so that spellings of one entity meet: coreference holds
   across formats and documents.
3. Every distinct entity draws a replacement from a keyed hash of kind, normal form and attempt: same length, digits for digits, a valid
   check digit for cards, octets for addresses, given names of the same gender and surnames of the same script and form.
4. Draws are checked: one that another entity of the kind holds or draws too, or that is itself an entity of the corpus, is drawn again by
   all but the least claimant. Rounds go on until every entity has its own.
5. Replacements are put back in the form of each occurrence (separators, letter case).

Entities only are shuffled and joined; texts without any stay where they are.

Not detected: names without a title or a given name of GIVEN or KNOWN, in capitals or small letters only, or in other scripts than Latin, Cyrillic and Greek; the second of two surnames;
national phones without separators or in other groups than 3-3-4 and those with a leading 0 below; cards in other groups than fours and 4-6-4 or 4-6-5; postal addresses and dates of birth.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Given names by gender and surname parts, by script. Fixed values.
GIVEN = {
    ("latin", "f"): ["Alice", "Anna", "Camille", "Carmen", "Chloe", "Clara", "Elena", "Emma", "Greta", "Hannah", "Ines", "Julia", "Laura", "Lucia", "Marie", "Petra", "Sophie", "Sabine"],
    ("latin", "m"): ["Antoine", "Carlos", "David", "Diego", "Felix", "Hans", "Hugo", "James", "Javier", "John", "Julien", "Klaus", "Lukas", "Michael", "Pablo", "Pierre", "Robert", "Thomas"],
    ("cyrillic", "f"): ["Анна", "Вера", "Елена", "Ирина", "Мария", "Ольга", "Светлана", "Татьяна"],
    ("cyrillic", "m"): ["Александр", "Борис", "Дмитрий", "Иван", "Михаил", "Николай", "Олег", "Сергей"],
    ("greek", "f"): ["Αθηνά", "Ελένη", "Ειρήνη", "Κατερίνα", "Μαρία", "Σοφία"],
    ("greek", "m"): ["Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος", "Σταύρος"],
}
SURNAME = {
    "latin": (["Al", "Ber", "Cor", "Dal", "Fer", "Gar", "Hol", "Kel", "Lan", "Mar", "Nor", "Par", "Ros", "Sal", "Tor", "Wal"],
              ["bach", "berg", "court", "dino", "field", "gado", "hart", "kins", "land", "mann", "net", "rand", "sen", "ton", "vez", "wick"]),
    "cyrillic": (["Бел", "Вор", "Гор", "Дол", "Зай", "Кал", "Лес", "Мор"], ["ак", "ил", "ин", "ош", "ук", "ют", "яр", "ян"]),
    "greek": (["Αλεξ", "Βασ", "Γερ", "Δημ", "Καρ", "Μαρ", "Νικ", "Παπ"], ["άκης", "άτος", "ίδης", "ίου", "όγλου", "όπουλος", "άς", "έας"]),
}
#: Given names that are found but not drawn, by gender. Fixed values.
KNOWN = {
    "f": """Maria Olivia Emily Sarah Jessica Jennifer Elizabeth Linda Patricia Barbara Susan Margaret Karen Nancy Lisa Betty Helen Sandra Donna Ashley Kimberly Michelle Amanda
        Melissa Deborah Stephanie Rebecca Sharon Cynthia Kathleen Amy Angela Shirley Brenda Pamela Nicole Samantha Katherine Catherine Christine Rachel Carolyn Janet Diane Jane Kate Lucy
        Isabella Mia Sophia Amelia Eleanor Monika Ursula Claudia Andrea Katharina Susanne Heike Birgit Ingrid Helga Renate Gisela Brigitte Lena Leonie Johanna Christina Martina Silke
        Nathalie Isabelle Sylvie Catherine Valérie Céline Aurélie Émilie Élodie Hélène Claire Manon Léa Juliette Margaux Ana Isabel Pilar Dolores Cristina Marta Rosa Teresa Beatriz Raquel
        Rocío María Lucía Sofía Inés Giulia Francesca Chiara Valentina Giovanna Joana Fatima Aisha Leila Priya Anjali Agnieszka Katarzyna Małgorzata Anastasia Olga Irina Svetlana Natalia
        Екатерина Наталья Юлия Людмила Галина Анастасия Ксения Валентина Надежда Марина Дарья Полина Алина Оксана Γεωργία Βασιλική Αναστασία Χριστίνα Δέσποινα Άννα Αγγελική Ιωάννα""".split(),
    "m": """William Richard Joseph Charles Christopher Daniel Matthew Anthony Steven Paul Andrew Joshua Kenneth Kevin Brian George Timothy Ronald Edward Jason Jeffrey Ryan Jacob Gary Nicholas
        Eric Jonathan Stephen Larry Justin Scott Brandon Benjamin Samuel Gregory Alexander Patrick Jack Dennis Jerry Tyler Aaron Henry Peter Adam Nathan Harry Oliver Liam Noah Ethan Simon
        Martin Wolfgang Jürgen Stefan Andreas Matthias Markus Sebastian Florian Tobias Jan Uwe Dieter Günter Heinz Helmut Karl Friedrich Johannes Maximilian Leon Jonas Jean Jacques
        Philippe François Laurent Nicolas Olivier Christophe Frédéric Sébastien Guillaume Mathieu Alexandre Louis Étienne René André José Juan Luis Miguel Antonio Manuel Francisco Jorge
        Alejandro Fernando Sergio Rafael Ángel Álvaro Raúl Andrés Jesús Marco Giuseppe Giovanni Luca Matteo Francesco João Pedro Mohammed Muhammad Ahmed Ali Omar Hassan Raj Amit Piotr Andrzej
        Krzysztof Ivan Dmitri Vladimir Sergei Алексей Андрей Владимир Евгений Игорь Максим Павел Роман Юрий Виктор Антон Артём Константин Γιάννης Βασίλης Χρήστος Παναγιώτης Αντώνης
        Αλέξανδρος Μιχάλης Θανάσης""".split(),
}
#: Words before a name; f and m also tell the gender. Fixed values.
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra"], "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr"], "": ["Dr", "Doctor", "Prof", "Professor"]}

NAMES = list(dict.fromkeys(n for names in (*GIVEN.values(), *KNOWN.values()) for n in names))
_TITLE = "|".join(t for titles in TITLES.values() for t in titles)
_INITIALS = r"(?:\p{Lu}\. ?){0,2}"
_SURNAME = r"(?:(?:van|von|der|den|de|del|dos|da|di) ){0,2}(?:[OD]['’]|Mc|Mac)?\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
#: Kind -> pattern, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})(?:\.[A-Za-z0-9-]{1,63}){0,6}\.[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "secret": r"(?=[0-9A-Fa-f]{32})(?<![A-Za-z0-9])(?:[0-9a-f]{64}|[0-9A-F]{64}|[0-9a-f]{40}|[0-9A-F]{40}|[0-9a-f]{32}|[0-9A-F]{32})(?![A-Za-z0-9])",
    "iban": r"(?=[A-Z]{2}[0-9]{2})(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?=[0-9]{1,3}\.)(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])",
    "card": r"(?=[0-9]{4})(?<![0-9A-Za-z])(?:[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?![0-9A-Za-z])",
    "ssn": r"(?=[0-9]{3}-)(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?=[+(][0-9]|[0-9]{2,5}[ ./-][0-9]|1[ .-][2-9])(?<![0-9A-Za-z+])(?:(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})|\([0-9]{2,4}\))(?:[ .-]?[0-9]{2,4}){2,4}|"
             r"(?<![0-9][.-])(?:(?:1[ .-])?[2-9][0-9]{2}[ .-][0-9]{3}[ .-][0-9]{4}|0[1-9](?:[ .-][0-9]{2}){4}|0[0-9]{2}[ -][0-9]{4}[ -][0-9]{4}|"
             r"0[0-9]{3,4}[ /-][0-9]{3}[ -]?[0-9]{3,4}|0[0-9]{2,4}[ /-][0-9]{6,8})(?![.-][0-9]))(?![0-9A-Za-z])",
    "name": rf"(?=\p{{Lu}}[\p{{L}}-]*\.? (?:\p{{Ll}}{{2,3}} ){{0,2}}\p{{Lu}})(?<!\p{{L}})(?:(?:(?:{_TITLE})\.? ){{1,2}}(?:(?:{'|'.join(NAMES)}) )?{_INITIALS}{_SURNAME}|(?:{'|'.join(NAMES)}) {_INITIALS}{_SURNAME})(?!\p{{L}})",
}
ANY = "|".join(PATTERNS.values())
ROUNDS = 40


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits, the last of which has weight one."""
    back = F.reverse(F.split(digits, "(?!^)(?!$)"))
    return F.aggregate(F.transform(back, lambda d, i: F.when(i % 2 == 1, (d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")).otherwise(d.cast("int"))),
                       F.lit(0), lambda a, x: a + x)


def kind_of(entity: Column) -> Column:
    """Kind of a candidate that ANY found, null if its rule fails."""
    first = None
    for kind, pattern in PATTERNS.items():
        whole = entity.rlike(f"^(?:{pattern})$")
        value = F.when(_luhn_sum(_digits(entity)) % 10 == 0, F.lit(kind)) if kind == "card" else F.lit(kind)
        first = F.when(whole, value) if first is None else first.when(whole, value)
    return first


def _given_of(entity: Column) -> Column:
    return F.regexp_extract(entity, rf"^(?:(?:{_TITLE})\.? )*(?:({'|'.join(NAMES)}) )?", 1)


def normal(kind: Column, entity: Column) -> Column:
    """Normal form: spellings of one entity have one."""
    name = F.regexp_replace(entity, rf"^(?:(?:{_TITLE})\.? )+", "")
    return (F.when(kind.isin("card", "ssn", "phone"), _digits(entity)).when(kind == "iban", F.regexp_replace(entity, " ", ""))
            .when(kind.isin("email", "secret"), F.lower(entity)).when(kind == "name", name).otherwise(entity))


def gender_of(entity: Column) -> Column:
    given, title = _given_of(entity), F.regexp_extract(entity, r"^(\p{L}+)", 1)
    out = F.lit("m")
    for gender, names in [*((g, names) for (_, g), names in GIVEN.items()), *KNOWN.items()]:
        out = F.when(given.isin(names), F.lit(gender)).otherwise(out)
    return F.when(title.isin(TITLES["f"]), F.lit("f")).when(title.isin(TITLES["m"]), F.lit("m")).otherwise(out)


def _stream(key: str, kind: Column, norm: Column, attempt: int) -> Column:
    """128 keyed hex digits, different for every attempt."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, norm, F.lit(str(attempt)))
    return F.concat(F.sha2(seed, 512), F.sha2(F.concat(seed, F.lit("\x1f+")), 512))


def _masked(norm: Column, stream: Column, kinds: str = "[0-9a-z]") -> Column:
    """norm with digits and letters drawn anew from the stream, position by position."""
    digit, letter, hexes = F.translate(stream, "abcdef", "395170"), F.translate(stream, "0123456789abcdef", "bcdfghklmnprstvw"), stream
    chars = F.split(norm, "(?!^)(?!$)")
    at = lambda i: F.pmod(i * 7, F.lit(251)) + 1
    return F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), F.substr(digit, at(i), F.lit(1))).when(c.rlike("[a-z]"), F.substr(letter, at(i), F.lit(1)))
                                    .when(c.rlike("[A-Z]"), F.upper(F.substr(letter, at(i), F.lit(1)))).otherwise(c)), "") if kinds != "hex" else F.substr(hexes, F.lit(1), F.length(norm))


def _number(stream: Column, at: int) -> Column:
    return F.conv(F.substr(stream, F.lit(at), F.lit(7)), 16, 10).cast("long")


def _pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def _name(norm: Column, gender: Column, stream: Column, attempt: int) -> Column:
    """Given name of the gender if there was one, and a made-up surname, both in the script; later attempts have double surnames."""
    script = F.when(norm.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).when(norm.rlike(r"\p{IsGreek}"), F.lit("greek")).otherwise(F.lit("latin"))
    out = None
    for (kind, own), names in GIVEN.items():
        heads, tails = SURNAME[kind]
        made = lambda at, h=heads, t=tails: F.concat(_pick(h, _number(stream, at)), _pick(t, _number(stream, at + 7)))
        last = made(1)
        if attempt >= 3:
            last = F.concat(last, F.lit("-"), made(15))
        if attempt >= 6:
            last = F.concat(last, F.lower(made(29)))
        value = F.concat(F.when(norm.contains(" "), F.concat(_pick(names, _number(stream, 50)), F.lit(" "))).otherwise(F.lit("")), last)
        case = (script == kind) & (gender == own)
        out = F.when(case, value) if out is None else out.when(case, value)
    return out


def drawn(key: str, kind: Column, norm: Column, gender: Column, attempt: int) -> Column:
    """Replacement of an entity at one attempt."""
    stream = _stream(key, kind, norm, attempt)
    octets = [F.substr(stream, F.lit(2 * i + 1), F.lit(2)) for i in range(4)]
    ip = F.concat_ws(".", *[(F.conv(o, 16, 10).cast("int") % 254 + 1).cast("string") for o in octets])
    body = F.concat(F.substr(norm, F.lit(1), F.lit(1)), F.substr(_masked(norm, stream), F.lit(2), F.length(norm) - 2))
    card = F.concat(body, F.pmod(-_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
    email = F.concat(_masked(F.regexp_extract(norm, r"^(.*)\.[a-z]+$", 1), stream), F.lit("."), F.regexp_extract(norm, r"\.([a-z]+)$", 1))
    iban = F.concat(F.substr(norm, F.lit(1), F.lit(2)), F.substr(_masked(norm, stream), F.lit(3), F.length(norm)))
    return (F.when(kind == "ip", ip).when(kind == "card", card).when(kind == "email", email).when(kind == "iban", iban).when(kind == "name", _name(norm, gender, stream, attempt))
            .when(kind == "secret", _masked(norm, stream, "hex")).otherwise(_masked(norm, stream)))


def assign(entities: DataFrame, key: str) -> DataFrame:
    """kind, norm, surrogate of distinct entities (kind, norm, gender): distinct within a kind, and none of the entities themselves."""
    entities = stage(entities)
    left, done, attempt = entities, None, 0
    while True:
        draw = left.withColumn("surrogate", drawn(key, F.col("kind"), F.col("norm"), F.col("gender"), attempt))
        taken = entities.select("kind", F.col("norm").alias("surrogate"))
        if done is not None:
            taken = taken.unionByName(done.select("kind", "surrogate"))
        free = draw.join(taken, ["kind", "surrogate"], "left_anti")
        won = stage(free.groupBy("kind", "surrogate").agg(F.min(F.struct("norm", "gender")).alias("m")).select("kind", F.col("m.norm").alias("norm"), "surrogate"))
        done = won if done is None else done.unionByName(won)
        left = stage(left.join(won.select("kind", "norm"), ["kind", "norm"], "left_anti"))
        attempt += 1
        if left.isEmpty():
            return done
        if attempt == ROUNDS:
            raise ValueError("entities of one form are as many as the form has values: no distinct surrogates are left")


def _formed(entity: Column, kind: Column, surrogate: Column) -> Column:
    """A surrogate in the form of one occurrence: its separators, its title, its letter case."""
    fill = F.aggregate(F.split(entity, "(?!^)(?!$)"), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
                       lambda s, c: F.when(c.rlike("[0-9A-Z]"), F.struct(F.concat(s["out"], F.substr(surrogate, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at")))
                       .otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))))["out"]
    title = F.regexp_extract(entity, rf"^((?:(?:{_TITLE})\.? )*)", 1)
    return (F.when(kind.isin("card", "ssn", "phone", "iban"), fill).when((kind == "secret") & (entity == F.upper(entity)), F.upper(surrogate))
            .when(kind == "name", F.concat(title, surrogate)).otherwise(surrogate))


def surrogates(docs: DataFrame, key: str = "rokad") -> DataFrame:
    """doc_id, text with surrogates, n_entities of every row.

    Null text stays null with no entity; texts without entities are unchanged, of any length. Equal entities get equal surrogates in all rows, different ones
    different. Repeated rows and null ids are rows like others. Other columns are ignored; an empty table stays empty. The key decides the draws;
    keep it secret where surrogates must not be linked to the originals.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = own.withColumn("ents", F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    has = F.coalesce(F.size("ents") > 0, F.lit(False))
    mark = F.struct("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("n"))
    # texts with candidates are few; the patterns run over the others once more, for what stays as it is. No cheaper test comes first: it would have to follow every pattern
    busy = stage(found.filter(has).withColumn("mark", mark))
    met = busy.select("mark", F.explode(F.array_distinct("ents")).alias("entity"))
    met = met.withColumn("kind", kind_of(F.col("entity"))).filter("kind is not null").withColumn("norm", normal(F.col("kind"), F.col("entity")))
    gender = F.when(F.col("kind") == "name", gender_of(F.col("entity"))).otherwise(F.lit(""))
    met = stage(met.distinct().withColumn("gender", gender))
    held = assign(met.groupBy("kind", "norm").agg(F.min("gender").alias("gender")), key)
    put = met.join(held, ["kind", "norm"]).select("mark", "entity", _formed(F.col("entity"), F.col("kind"), F.col("surrogate")).alias("put"))
    maps = put.groupBy("mark").agg(F.map_from_entries(F.collect_list(F.struct("entity", "put"))).alias("map"))
    joined = busy.join(maps.withColumnRenamed("mark", "to"), F.col("mark").eqNullSafe(F.col("to")), "left")
    swap = lambda e: F.coalesce(F.element_at("map", e), e)
    pieces = F.split("text", ANY, -1)
    text = F.array_join(F.transform(pieces, lambda p, i: F.when(i < F.size("ents"), F.concat(p, swap(F.element_at("ents", i + 1)))).otherwise(p)), "")
    count = F.size(F.filter("ents", lambda e: F.element_at("map", e).isNotNull()))
    changed = joined.select("doc_id", F.when(F.col("map").isNull(), F.col("text")).otherwise(text).alias("text"), F.coalesce(F.when(F.col("map").isNotNull(), count), F.lit(0)).cast("long").alias("n_entities"))
    return changed.unionByName(found.filter(~has).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities")))
