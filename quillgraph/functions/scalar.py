"""Scalar column functions of the graph engine, all built from Catalyst expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TIERS = ("public", "personal", "private", "secret")
SHOWN = ("public", "personal")
AGGREGATE_METHODS = ("npmi", "knn", "structural", "temporal")
ANCHOR_LAST = ("event", "series", "document", "artifact")


def canonicalize(s: Column) -> Column:
    return F.lower(F.trim(s))


def normalize(s: Column) -> Column:
    """Lower case, letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", " "))


def content_hash(s: Column) -> Column:
    return F.sha2(s, 256)


def estimate_tokens(s: Column) -> Column:
    """A quarter of the bytes, rounded down."""
    return F.floor(F.octet_length(s) / 4).cast("bigint")


def query_terms(s: Column) -> Column:
    """Search terms: alphanumeric runs of more than two bytes, in order of appearance."""
    return F.filter(F.split(normalize(s), " "), lambda t: F.octet_length(t) > 2)


def preview(s: Column, n: int = 700) -> Column:
    return F.substring(s, 1, n)


def dot(a: Column, b: Column) -> Column:
    both = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(both, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def l2_distance(a: Column, b: Column) -> Column:
    both = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(both, F.lit(0.0), lambda acc, x: acc + x))


def stem_token(t: Column) -> Column:
    """Drop one of ing, ies, ed, es, s where three letters are left."""
    out = t
    for ending in reversed(("ing", "ies", "ed", "es", "s")):
        fits = t.endswith(ending) & (F.char_length(t) >= len(ending) + 3)
        out = F.when(fits, F.substring(t, F.lit(1), F.char_length(t) - len(ending))).otherwise(out)
    return out


def stem_predicate(p: Column) -> Column:
    return F.array_join(F.transform(F.split(p, "_"), stem_token), "_")


def contains_word(text: Column, word: Column) -> Column:
    """Whether `word` occurs in `text` between characters that aren't ASCII letters or digits."""
    quoted = F.concat(F.lit("(^|[^0-9A-Za-z])\\Q"), word, F.lit("\\E([^0-9A-Za-z]|$)"))
    return F.rlike(text, quoted)


def lexically_supports(body: Column, term: Column) -> Column:
    """Whether the term's words occur in the body as one run of whole words."""
    padded = F.concat(F.lit(" "), normalize(body), F.lit(" "))
    wanted = normalize(term)
    return (wanted != "") & (F.instr(padded, F.concat(F.lit(" "), wanted, F.lit(" "))) > 0)


def wilson_lower_bound(accepted: Column, n: Column, z: float = 1.96) -> Column:
    p = accepted / n
    zz = z * z
    root = F.sqrt(p * (1 - p) / n + zz / (4.0 * n * n))
    return F.when(n > 0, (p + zz / (2.0 * n) - z * root) / (1 + zz / n)).otherwise(F.lit(0.0))


def beta_from_rate(rate: Column, strength: float = 10.0) -> tuple[Column, Column]:
    held = F.greatest(F.lit(0.05), F.least(F.lit(0.95), rate))
    return held * strength, (1 - held) * strength


def posterior_mean(alpha: Column, beta: Column, supports: Column, disputes: Column) -> Column:
    return (alpha + supports) / (alpha + beta + supports + disputes)


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400e6)


def activation(touches: Column, days: Column) -> Column:
    """ln(n / 0.5) - 0.5 ln(days), held within [-2, 4]; a lifetime counts as 0.02 days at least."""
    raw = F.log(touches / 0.5) - 0.5 * F.log(F.greatest(days, F.lit(0.02)))
    return F.when(touches > 0, F.greatest(F.lit(-2.0), F.least(F.lit(4.0), raw))).otherwise(F.lit(-2.0))


def health_score(confidence: Column, days: Column, accesses: Column) -> Column:
    return confidence * F.exp(-0.015 * days) * F.least(F.lit(1.0), 0.3 + 0.1 * accesses)


def sensitivity_rank(s: Column) -> Column:
    """Position in the order of tiers; an unknown tier ranks as the most sensitive."""
    out = F.lit(len(TIERS) - 1)
    for k, tier in enumerate(TIERS[:-1]):
        out = F.when(s == tier, k).otherwise(out)
    return out


def tier_of(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in TIERS]), rank + 1)


def is_aggregate_method(m: Column) -> Column:
    return m.isin(*AGGREGATE_METHODS) | m.startswith("linker:")


def is_agent(extractor: Column) -> Column:
    return extractor.startswith("probe") | extractor.startswith("agent:") | extractor.startswith("precheck:")


def is_live() -> Column:
    return F.col("valid_to").isNull() & F.col("invalidated_at").isNull()


def ts_text(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd HH:mm:ss")


def title_case_name(s: Column) -> Column:
    """Capitalise the words of a name; particles stay small unless they lead, initials get a dot."""
    words = F.split(F.lower(F.trim(s)), r"\s+")
    small = F.array(*[F.lit(w) for w in ("al", "bin", "da", "de", "del", "der", "di", "du", "la", "le", "van", "von")])

    def cased(w: Column, i: Column) -> Column:
        dotted = F.concat(F.upper(w), F.lit("."))
        return F.when((i > 0) & F.array_contains(small, w), w).when(F.char_length(w) == 1, dotted).otherwise(F.initcap(w))

    return F.array_join(F.transform(words, cased), " ")


def normalize_subject(s: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(s)), r"^((re|fwd|fw):\s*)+", "")


def normalize_handle(s: Column) -> Column:
    return F.when(F.contains(s, F.lit("@")), F.lower(F.trim(s))).otherwise(F.regexp_replace(s, "[^0-9+]", ""))


def apple_date_to_epoch(v: Column) -> Column:
    """Seconds since 1970 from seconds or nanoseconds since 2001, told apart by size."""
    return F.when(F.abs(v) > 1_000_000_000_000, F.floor(v / 1_000_000_000)).otherwise(v).cast("bigint") + 978_307_200


def slugify(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def backlinks(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))


def parse_due(s: Column, as_of: Column) -> Column:
    """today, tomorrow, +Nd or an ISO date; null for anything else."""
    word = F.lower(F.trim(s))
    shift = F.regexp_extract(word, r"^\+(\d{1,5})d$", 1)
    iso = F.regexp_extract(word, r"^(\d{4}-\d{2}-\d{2})$", 1)
    return (
        F.when(word == "today", as_of.cast("date"))
        .when(word == "tomorrow", F.date_add(as_of.cast("date"), 1))
        .when(shift != "", F.date_add(as_of.cast("date"), F.when(shift != "", shift).cast("int")))
        .when(iso != "", F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"))
    )


def parse_cooccurrence(statement: Column) -> tuple[Column, Column]:
    """(shared episodes, NPMI) that a statement declares, null where it declares none."""
    pattern = r"\((\d+) shared episodes, NPMI ([-0-9.]+)\)"
    n, value = (F.regexp_extract(statement, pattern, k) for k in (1, 2))
    return F.when(n != "", n).cast("int"), F.when(value != "", value).cast("double")


def cooccurrence_statement(a: Column, b: Column, n: Column, npmi: Column) -> Column:
    return F.format_string("%s and %s co-occur (%d shared episodes, NPMI %.2f)", a, b, n, npmi)


def candidate_text(payload: Column) -> Column:
    """What a candidate says: its statement, else what is owed, else its value."""
    return F.coalesce(F.get_json_object(payload, "$.statement"), F.get_json_object(payload, "$.what"), F.get_json_object(payload, "$.object_value"))


def cluster_key(payload: Column) -> Column:
    return F.coalesce(F.get_json_object(payload, "$.predicate"), F.get_json_object(payload, "$.kind"), F.lit("?"))


def best_label(name: Column, longest_alias: Column) -> Column:
    """A name that isn't an address or an identifier, else the longest alias, else the name."""
    plain = ~F.contains(name, F.lit("@")) & (F.trim(name) != "")
    return F.coalesce(F.when(plain, name), longest_alias, name)


LN2 = math.log(2)


_VERBS = "is are was were has have had will would should can could may might must does do did needs went goes comes came includes involves requires remains became becomes seems appears gets got".split()
_PRONOUNS = "he she they it we i you there this that these those someone somebody everyone".split()


def subject_phrase(text: Column) -> Column:
    """The one to four words before a statement's first verb, without an article; null where it begins with a pronoun or no verb follows."""
    words = F.split(F.trim(text), r"\s+")
    words = F.when(F.lower(F.get(words, F.lit(0))).isin("the", "a", "an"), F.slice(words, 2, 100_000)).otherwise(words)
    bare = F.transform(F.slice(words, 1, 5), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}'-]", ""))
    verb = F.array_position(F.transform(bare, lambda w: F.lower(w).isin(*_VERBS)), True)
    phrase = F.slice(bare, F.lit(1), F.greatest(F.lit(0), verb - 1).cast("int"))
    fits = (verb > 1) & ~F.lower(F.get(bare, F.lit(0))).isin(*_PRONOUNS) & ~F.array_contains(phrase, "")
    return F.when(fits & (F.octet_length(F.array_join(phrase, " ")) >= 3), F.array_join(phrase, " "))


def json_set(doc: Column, key: str, value: Column) -> Column:
    """A JSON object of strings with one key set; a text that isn't an object counts as an empty one."""
    old = F.coalesce(F.from_json(doc, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.to_json(F.map_concat(F.map_filter(old, lambda k, v: k != F.lit(key)), F.create_map(F.lit(key), value.cast("string"))))
