"""Advisory page rules: markup hygiene, loose symbols, misspellings, phrasing and rhythm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegate.functions import html as H
from pagegate.functions.text import WS, collapse_ws, holds_any, js_trim, let, word_count
from pagegate.operators.findings import ITEMS, Detector, Hit, Listed, item, text

Q, C = H.Q, F.col
L, R = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"

# Link texts that say nothing about the target.
GENERIC_LINK_TEXT = (
    "click here", "read more", "here", "more", "learn more", "link", "this", "read", "go", "click",
)
# Tags dropped from the standard.
DEPRECATED_TAGS = ("center", "font", "marquee", "blink", "big", "tt", "strike")


def _one(rule_id: str, section: str, when: Column, items: Column) -> Hit:
    return Hit(rule_id, section, when, text(F.size(items), " occurrence(s)"), "", items)


def best_practices():
    doctype = C("doctype")
    charset = H.matches(C("html"), rf"(?i)<meta{WS}+charset=") | H.matches(
        C("html"), f"(?i)<meta[^>]+http-equiv={Q}?content-type{Q}[^>]*charset="
    )
    each = F.filter(
        F.array(
            *[F.when(H.matches(C("html"), f"(?i)<{t}[{WS[1:-1]}>/]"), item(t, "body", f"<{t}>")) for t in DEPRECATED_TAGS]
        ),
        lambda x: x.isNotNull(),
    )
    old = F.when(H.matches(C("html"), f"(?i)<(?:{'|'.join(DEPRECATED_TAGS)})[{WS[1:-1]}>/]"), each).otherwise(F.array().cast(ITEMS))
    unsafe = F.filter(
        C("anchors"),
        lambda t: t.rlike(rf"(?i)target{WS}*={WS}*{Q}?_blank")
        & ~F.regexp_extract(t, rf"(?i)rel{WS}*={WS}*{Q}([^\"']*){Q}", 1).rlike("(?i)noopener|noreferrer"),
    )
    link_texts = F.transform(
        H.find_all(C("html"), r"(?is)<a\b[^>]*>(.*?)</a>", 1),
        lambda x: F.lower(collapse_ws(F.regexp_replace(x, "<[^>]+>", ""))),
    )
    vague = F.filter(link_texts, lambda x: x.isin(*GENERIC_LINK_TEXT))
    generator = H.first_match(
        C("html"), rf"(?i)<meta{WS}+name={Q}generator{Q}[^>]*content={Q}([^\"']*){Q}", 1
    )
    handlers = F.array_sort(
        F.array_distinct(
            F.transform(
                H.find_all(C("html"), rf"(?i)o(?<={WS}o)n([a-z]+){WS}*={WS}*{Q}", 1), lambda x: F.concat(F.lit("on"), F.lower(x))
            )
        )
    )
    live = C("status") == 200
    return [
        _one("BP-001", "document", live & doctype.isNull(), F.array(item("doctype", "document", "missing"))),
        _one("BP-002", "head", live & ~charset, F.array(item("charset", "head", "missing"))),
        _one("BP-003", "body", live & (F.size(old) > 0), old),
        _one(
            "BP-004", "body", live & (F.size(unsafe) > 0),
            F.transform(unsafe, lambda t: item("anchor", "body", F.substring(t, 1, 100))),
        ),
        _one(
            "BP-005", "body", live & (F.size(vague) > 0),
            F.transform(vague, lambda t: item("link-text", "body", t)),
        ),
        _one("BP-006", "head", live & generator.isNotNull(), F.array(item("generator", "head", generator))),
        _one(
            "BP-007", "body", live & (F.size(handlers) > 0), F.transform(handlers, lambda h: item(h, "body", h))
        ),
        _one(
            "BP-008", "document",
            live & doctype.isNotNull() & ~H.matches(doctype, rf"(?i)^<!doctype{WS}+html{WS}*>$"),
            F.array(item("doctype", "document", F.substring(doctype, 1, 80))),
        ),
    ]


# ---- matches with their surroundings -------------------------------------------------------


def located(prose: Column, pattern: str, may: Column) -> Column:
    """All matches of a pattern with the position each starts at (zero based). `may` is false only where there are none;
    most texts have none and are looked through once at most."""
    both = F.struct(H.find_all(prose, pattern).alias("raws"), F.split(prose, pattern, -1).alias("gaps"))
    found = let(
        both,
        lambda b: F.transform(
            b["raws"],
            lambda r, i: F.struct(
                r.alias("raw"),
                (
                    F.length(F.array_join(F.slice(b["gaps"], 1, i + 1), ""))
                    + F.length(F.array_join(F.slice(b["raws"], 1, i), ""))
                ).alias("pos"),
            ),
        ),
    )
    return F.when(may & prose.rlike(pattern), found).otherwise(F.array().cast("array<struct<raw:string,pos:int>>"))


def snippet(prose: Column, m: Column, around: int, limit: int) -> Column:
    start = F.greatest(m["pos"] - around, F.lit(0))
    end = m["pos"] + F.length(m["raw"]) + around
    return F.substring(js_trim(F.substring(prose, start + 1, end - start)), 1, limit)


# What loose symbols look like in visible copy.
ARTIFACTS = (
    (
        "unresolved-token",
        r"\{\{" + f"{WS}*" + r"[^{}]{1,60}?" + f"{WS}*" + r"\}\}|\{%" + f"{WS}*" + r"[^%]{1,60}?%\}|\$\{" + f"{WS}*" + r"[^{}]{1,60}?\}",
    ),
    ("replacement-char", "\ufffd"),
    ("mojibake", "\u00c3[\u0080-\u00bf]|\u00c2[\u00a0-\u00bf]|\u00e2(?:\u20ac|\u0080)"),
    ("double-escaped-entity", r"(?i)&amp;(?:amp|lt|gt|quot|nbsp|#[0-9]{1,6}|[a-z]{2,8});"),
    ("stray-control-char", "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"),
)
# What the text of a match holds at least one of, in lower case.
ARTIFACT_SIGNS = {
    "unresolved-token": ("{{", "{%", "${"),
    "replacement-char": ("\ufffd",),
    "mojibake": ("\u00e3", "\u00e2"),
    "double-escaped-entity": ("&amp;",),
}


def _first_of_each(found: Column, same) -> Column:
    """Keeps the first of equal matches, in order."""
    return let(
        found,
        lambda all_: F.filter(
            all_, lambda m, i: ~F.exists(F.slice(all_, 1, i), lambda p: same(p["raw"], m["raw"]))
        ),
    )


def _artifact_group(prose: Column, lower: Column, name: str, pattern: str) -> Column:
    may = holds_any(lower, ARTIFACT_SIGNS[name]) if name in ARTIFACT_SIGNS else F.lit(True)
    first = _first_of_each(located(prose, pattern, may), lambda a, b: a == b)
    shown = (
        (lambda m: F.substring(m["raw"], 1, 80))
        if name == "unresolved-token"
        else (lambda m: snippet(prose, m, 18, 80))
    )
    return F.transform(first, lambda m: item(name, "content", shown(m)))


def artifact_items(prose: Column, lower: Column) -> Column:
    groups = [_artifact_group(prose, lower, name, pattern) for name, pattern in ARTIFACTS]
    return F.array_sort(F.flatten(F.array(*groups)))


def content_artifacts():
    items = artifact_items(C("visible"), C("visible_lower"))
    return [
        Listed("FUNC-008", "content", C("status") == 200, items, lambda its: text(F.size(its), " artifact(s)"))
    ]


# Words whose doubling is always a slip.
DOUBLE_WORDS = ("the", "a", "an", "and", "or", "of", "to", "in", "on", "is", "are", "was", "for", "with")

# Misspelling and the word meant.
MISSPELLINGS_TEXT = """
accomodate accommodate, acheive achieve, acheived achieved, adress address, agressive aggressive,
apparant apparent, arguement argument, assistanse assistance, basicly basically, becuase because,
beleive believe, beleived believed, begining beginning, beeing being, bizness business,
buisness business, calender calendar, catagory category, cemetary cemetery, changable changeable,
collegue colleague, comming coming, commited committed, completly completely, concious conscious,
consistant consistent, continous continuous, definately definitely, dependant dependent,
desparate desperate, diffrent different, dissapoint disappoint, dissapear disappear,
embarass embarrass, enviroment environment, equiptment equipment, existance existence,
experiance experience, familar familiar, febuary february, finaly finally, flexable flexible,
flourescent fluorescent, foriegn foreign, freind friend, fufill fulfill, garantee guarantee,
gaurd guard, goverment government, grammer grammar, happend happened, harrass harass, hieght height,
immediatly immediately, independant independent, intergrate integrate, knowlege knowledge,
liason liaison, libary library, lisence license, maintainance maintenance, managable manageable,
millenium millennium, minature miniature, mispell misspell, neccessary necessary,
neccesary necessary, noticable noticeable, occassion occasion, occured occurred, occuring occurring,
occurence occurrence, paralell parallel, peice piece, persistant persistent, posession possession,
posess possess, practial practical, prefered preferred, priviledge privilege, probaly probably,
proffesional professional, pronounciation pronunciation, publically publicly, quater quarter,
questionaire questionnaire, recieve receive, recieved received, reciept receipt,
recomend recommend, recomended recommended, refered referred, relevent relevant,
religous religious, remeber remember, responce response, resturant restaurant, rythm rhythm,
seperate separate, seperated separated, seperately separately, similiar similar,
sincerly sincerely, speach speech, succesful successful, successfull successful,
succesfully successfully, suprise surprise, suprised surprised, temperture temperature,
tendancy tendency, therefor therefore, threshhold threshold, tommorow tomorrow, tommorrow tomorrow,
tounge tongue, truely truly, unfortunatly unfortunately, untill until, useable usable,
vaccum vacuum, vehical vehicle, wich which, wierd weird, writting writing, yeild yield, teh the,
thier their, adn and, alot a lot, becomeing becoming, accross across, appropiate appropriate,
availible available, belive believe, comitment commitment, developement development,
garenteed guaranteed, intresting interesting, oppurtunity opportunity, payed paid,
personel personnel, proccess process, reccomend recommend, succes success, wether whether,
withdrawl withdrawal
"""
MISSPELLINGS = dict(
    entry.strip().split(" ", 1) for entry in MISSPELLINGS_TEXT.replace("\n", " ").split(",")
)


def misspelled_words(lower: Column) -> Column:
    """Listed misspellings of a text in lower case, each once. A hash intersection, not a lookup per word; words of one
    or two letters are none."""
    words = H.find_all(lower, "[a-z][a-z']+[a-z]")
    return F.array_intersect(words, F.array(*[F.lit(w) for w in MISSPELLINGS]))


def doubled_words(prose: Column) -> Column:
    """Doubled function words of a text, lower case with single spaces, each once."""
    pattern = f"(?i){L}({'|'.join(DOUBLE_WORDS)}){WS}+\\1{R}"
    return F.array_distinct(
        F.transform(H.find_all(prose, pattern), lambda m: F.lower(F.regexp_replace(m, f"{WS}+", " ")))
    )


# A doubled word in copy whose white space is single spaces, looked for at the space.
DOUBLED = f"(?i) (?:{'|'.join(f'{w}(?<={L}{w} {w})' for w in DOUBLE_WORDS)}){R}"


def spelling_items(prose: Column, lower: Column) -> Column:
    """Misspelled and doubled words of collapsed copy."""
    meant = F.create_map(*[F.lit(x) for pair in MISSPELLINGS.items() for x in pair])
    typos = F.transform(
        misspelled_words(lower), lambda w: item("misspelling", "content", text('"', w, '" → "', meant[w], '"'))
    )
    doubles = F.transform(
        F.when(prose.rlike(DOUBLED), doubled_words(prose)).otherwise(F.array().cast("array<string>")),
        lambda p: item("doubled-word", "content", text('repeated "', p, '"'))
    )
    return F.array_sort(F.concat(typos, doubles))


def spelling():
    items = spelling_items(C("visible"), C("visible_lower"))
    return [
        Listed("FUNC-009", "content", C("status") == 200, items, lambda its: text(F.size(its), " issue(s)"))
    ]


# Assistant text left in copy, unfilled slots, and stock phrases.
BOILERPLATE = (
    "(?i)as an AI language model",
    "(?i)I'm sorry,? but (I can'?t|as an AI)",
    "(?i)as of my last (knowledge )?(update|training)",
    "(?i)I cannot browse the internet",
    f"(?im)^(certainly|sure)[!,]{WS}+here('s| is){R}",
    "(?i)here('s| is) (a|the) (rewritten|revised) version",
)
AUTHOR_SLOTS = (
    r"(?i)\[INSERT[^\]]{0,40}\]",
    r"(?i)\[YOUR [^\]]{0,40}\]",
    r"(?i)\[COMPANY[^\]]{0,30}\]",
    r"(?i)\[TODO[^\]]{0,30}\]",
    f"{L}TK{R}",
    f"{L}TODO:",
    f"{L}FIXME{R}",
    "XXXX+",
)
STOCK_PHRASES = (
    f"(?i){L}delve into{R}",
    "(?i)in today's (fast-paced|digital) world",
    "(?i)it'?s (important|worth) (to )?not(e|ing)",
    "(?i)unlock the (power|potential)",
    f"(?i){L}elevate your{R}",
    "(?i)navigate the (complex|ever-)",
    f"(?i){L}a testament to{R}",
    f"(?i){L}in the realm of{R}",
    "(?i)seamlessly integrat",
    "(?i)robust (solution|framework)",
)
# What the text of a match of each pattern above holds, in lower case.
COPY_SIGNS = dict(
    zip(
        (*BOILERPLATE, *AUTHOR_SLOTS, *STOCK_PHRASES),
        (
            "as an ai language model", "i'm sorry", "as of my last ", "i cannot browse the internet", "here", "version",
            "[insert", "[your ", "[company", "[todo", "tk", "todo:", "fixme", "xxxx",
            "delve into", "in today's ", "not", "unlock the p", "elevate your", "navigate the ", "a testament to", "in the realm of",
            "seamlessly integrat", "robust ",
        ),
        strict=True,
    )
)
COPY_RULES = (
    ("COPY-001", "llm-boilerplate-leak", BOILERPLATE, True),
    ("COPY-002", "unresolved-authoring-placeholder", AUTHOR_SLOTS, True),
    ("COPY-003", "ai-tell-phrasing", STOCK_PHRASES, False),
)

# A rhythm is judged from this much text, and uniform below this variation.
MIN_PARAGRAPHS, MIN_WORDS, MAX_CV = 8, 300, 0.18


def copy_items(prose: Column, lower: Column, name: str, patterns: tuple[str, ...], once: bool) -> Column:
    found = F.flatten(F.array(*[located(prose, p, lower.contains(COPY_SIGNS[p])) for p in patterns]))
    if once:
        found = _first_of_each(found, lambda a, b: F.lower(a) == F.lower(b))
    return F.array_sort(F.transform(found, lambda m: item(name, "content", snippet(prose, m, 24, 100))))


def paragraph_words(paras: Column) -> Column:
    """Word counts of the paragraphs that hold words."""
    return F.filter(F.transform(paras, lambda p: word_count(p).cast("long")), lambda n: n > 0)


def rhythm(counts: Column) -> Column:
    """Struct of paragraph count, words, mean and variation, from exact sums of the word counts."""
    sums = F.aggregate(
        counts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("q")),
        lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")),
    )
    return let(
        sums,
        lambda t: F.struct(
            t["n"].cast("int").alias("paragraphs"),
            t["s"].cast("int").alias("words"),
            F.try_divide(t["s"], t["n"]).alias("mean"),
            F.try_divide(F.sqrt(t["n"] * t["q"] - t["s"] * t["s"]), t["s"]).alias("cv"),
        ),
    )


def is_uniform(r: Column) -> Column:
    return (r["paragraphs"] >= MIN_PARAGRAPHS) & (r["words"] >= MIN_WORDS) & (r["cv"] < MAX_CV)


def copy_review():
    live = C("status") == 200
    hits = []
    for rule_id, name, patterns, once in COPY_RULES:
        items = copy_items(C("visible"), C("visible_lower"), name, patterns, once)
        hits.append(
            Listed(
                rule_id, "content", live, items,
                lambda its: text(F.size(its), " item(s) flagged for review (does not affect score)"),
            )
        )
    r = C("rhythm")
    value = F.format_string(
        "%d paragraphs, %d words, mean %.1f words/paragraph, CV %.3f (threshold < 0.18)",
        r["paragraphs"], r["words"], r["mean"], r["cv"],
    )
    hits.append(
        Hit(
            "COPY-004", "content", live & is_uniform(r), "1 item(s) flagged for review (does not affect score)", "",
            F.array(item("uniform-paragraph-rhythm", "content", value)),
        )
    )
    return hits


ADVISORY = {
    d.check_id: d
    for d in (
        Detector("best-practices", best_practices),
        Detector("content-artifacts", content_artifacts),
        Detector("spelling", spelling),
        Detector("copy-review", copy_review),
    )
}


def copy_words(ctx: DataFrame) -> DataFrame:
    """Visible words per site and scan, the base of the phrase density."""
    live = ctx.filter(C("status") == 200)
    return live.groupBy("site", "scan_id").agg(F.sum(word_count(C("visible")).cast("long")).alias("words"))
