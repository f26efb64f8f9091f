"""String, array and JSON functions of the document pipeline, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of what is no word, and of words.
URL = r"(?i)https?://\S+|www\.\S+"
TOKEN = r"[\p{L}\p{N}]+(?:['’\-][\p{L}\p{N}]+)*"

# Words that no glossary term holds, but as single letters.
STOPWORDS = ["a", "an", "and", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "the", "to", "was", "were", "with", "this", "that", "these", "those", "et", "en", "un", "une"]

# Language names and their codes.
LANGUAGE_CODES = {
    "vietnamese": "vi",
    "tiếng việt": "vi",
    "english": "en",
    "english (united states)": "en-US",
    "american english": "en-US",
    "french": "fr",
    "spanish": "es",
    "german": "de",
    "italian": "it",
    "portuguese": "pt",
    "japanese": "ja",
    "chinese": "zh",
    "korean": "ko",
    "russian": "ru",
    "arabic": "ar",
}

# Levels that a reasoning model offers.
THINKING_LEVELS = ["off", "minimal", "low", "medium", "high", "xhigh", "max"]

NO_GLOSSARY = "# No fixed glossary entries were found.\n"


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normal_text(c: Column, limit: int) -> Column:
    """Runs of white space as one space, trimmed, then cut to limit code points; a space may end the cut."""
    return F.left(strip(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " ")), F.lit(limit))


def without_urls(c: Column) -> Column:
    """Texts that hold neither beginning of a URL are not gone through."""
    some = c.contains("://") | F.lower(c).contains("www.")
    return F.when(some, F.regexp_replace(c, URL, " ")).otherwise(c)


def tokens(c: Column) -> Column:
    """Words of letters and digits, joined inside by apostrophes or hyphens; URLs go first."""
    return F.regexp_extract_all(without_urls(c), F.lit(TOKEN), 0)


#: A token that begins in upper case, whole; and two or more of them that follow each other, the first not inside a token.
_UPPER_TOKEN = r"(?=\p{IsUppercase})[\p{L}\p{N}]++(?:['’\-][\p{L}\p{N}]++)*+"
UPPER_RUN = rf"(?=\p{{IsUppercase}})(?<![\p{{L}}\p{{N}}])(?<![\p{{L}}\p{{N}}]['’\-]){_UPPER_TOKEN}(?:[^\p{{L}}\p{{N}}]++{_UPPER_TOKEN})++"


def upper_runs(c: Column) -> Column:
    """The longest runs of two or more tokens that begin in upper case, as they stand in the text without its URLs."""
    return F.regexp_extract_all(without_urls(c), F.lit(UPPER_RUN), 0)


def _folds() -> dict[str, str]:
    """By the rule of full case folding: what each lower-case character folds to, where that differs."""
    lows = {c.lower() for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x20000)))}
    return {c: c.casefold() for c in sorted(lows) if len(c) == 1 and c.casefold() != c}


_FOLDS = _folds()
_SINGLE = {c: f for c, f in _FOLDS.items() if len(f) == 1}
_SEVERAL = {c: f for c, f in _FOLDS.items() if len(f) > 1}


def casefold(c: Column) -> Column:
    """Full case folding: lower case, then what folds further; plain ASCII takes the first step alone."""
    low = F.lower(c)
    one = F.translate(low, "".join(_SINGLE), "".join(_SINGLE.values()))
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in _SEVERAL.items()])
    many = F.aggregate(pairs, one, lambda s, p: F.replace(s, p["k"], p["v"]))
    return F.when(~low.rlike(r"[^\x00-\x7F]"), low).when(low.rlike("[" + "".join(_SEVERAL) + "]"), many).otherwise(one)


def _ranges(points: list[int]) -> str:
    """Code points as the inside of a character class."""
    found: list[list[int]] = []
    for p in points:
        if found and p == found[-1][1] + 1:
            found[-1][1] = p
        else:
            found.append([p, p])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in found)


#: Digits that no decimal number has, such as superscripts and numbers in circles.
_OTHER_DIGITS = _ranges([p for p in range(0x110000) if chr(p).isdigit() and not chr(p).isdecimal()])


def all_digits(c: Column) -> Column:
    return c.rlike(rf"^[\p{{Nd}}{_OTHER_DIGITS}]+$")


def starts_upper(c: Column) -> Column:
    return c.rlike(r"^\p{IsUppercase}")


def blocks_term(token: Column) -> Column:
    """Whether a token keeps any phrase with it from being a glossary term. What settles most tokens comes first."""
    stop = (F.char_length(token) > 1) & casefold(token).isin(STOPWORDS)
    return ~starts_upper(token) | stop | all_digits(token)


def ordered_distinct(values: Column) -> Column:
    return F.array_distinct(values)


def lines(c: Column) -> Column:
    """Trimmed lines that aren't blank, each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(c, r"\r?\n"), strip), lambda x: x != ""))


# ---- locators


def locator(text: Column) -> Column:
    """'1/0/3' as numbers."""
    return F.when(text == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(text, "/"), lambda x: x.cast("int")))


def locator_text(numbers: Column) -> Column:
    return F.array_join(F.transform(numbers, lambda x: x.cast("string")), "/")


# ---- names and codes


def safe_name(c: Column) -> Column:
    """Letters, digits, dot, underscore and hyphen; anything else as one hyphen; 'book' if nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}._-]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("book"))


def language_code(name: Column) -> Column:
    """Code of a language name; else of what stands before a comma or parenthesis; else null."""
    codes = F.create_map(*[F.lit(x) for kv in LANGUAGE_CODES.items() for x in kv])
    clean = F.lower(strip(name))
    return F.coalesce(F.element_at(codes, clean), F.element_at(codes, strip(F.split(clean, "[,(]", 2)[0])))


def normal_language_code(code: Column) -> Column:
    """Primary part lower case, parts of two or three letters upper case; null if malformed."""
    parts = F.split(strip(code), "-")
    fine = F.forall(F.slice(parts, 2, 1000), lambda x: x.rlike("^[A-Za-z0-9]{2,8}$")) & F.get(parts, F.lit(0)).rlike("^[A-Za-z]{2,3}$")
    cased = F.transform(parts, lambda x, i: F.when(i == 0, F.lower(x)).when(F.length(x).isin(2, 3), F.upper(x)).otherwise(x))
    return F.when(fine, F.array_join(cased, "-"))


def worker_count(c: Column) -> Column:
    """A positive integer without sign or leading zero; else null."""
    return F.when(c.rlike(r"^[1-9][0-9]*$"), c.cast("int"))


def model_identifier(provider: Column, model: Column) -> Column:
    return F.concat_ws("/", provider, model)


def model_label(provider: Column, model: Column, name: Column) -> Column:
    base = model_identifier(provider, model)
    return F.when(name.isNotNull() & (name != ""), F.concat(name, F.lit(" ("), base, F.lit(")"))).otherwise(base)


def model_at(label: Column, models: Column) -> Column:
    """The first of models (provider, id, name) that is shown under a label; null if none is."""
    return F.get(F.filter(models, lambda m: model_label(m["provider"], m["id"], m["name"]) == label), F.lit(0))


def thinking_levels(reasoning: Column) -> Column:
    return F.when(reasoning == F.lit(False), F.array(F.lit("off"))).otherwise(F.array(*map(F.lit, THINKING_LEVELS)))


def preferred(scoped: Column, available: Column) -> Column:
    """The scoped models if there are any, else all."""
    return F.when(F.size(F.coalesce(scoped, F.array().cast("array<string>"))) > 0, scoped).otherwise(available)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def run_path(run_dir: Column, value: Column) -> Column:
    """Absolute paths stay; others lie in the run's folder."""
    return F.when(value.startswith("/"), value).otherwise(F.concat_ws("/", run_dir, value))


# ---- progress


def elapsed(started_at: Column, now_ms: Column) -> Column:
    """'1h 2m 3s', '2m 3s' or '3s', from epoch seconds to epoch milliseconds; never below zero."""
    s = F.greatest(F.lit(0), F.floor(now_ms / 1000 - started_at)).cast("long")
    hours, minutes, seconds = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    tail = F.concat(minutes, F.lit("m "), seconds, F.lit("s"))
    return F.when(hours > 0, F.concat(hours, F.lit("h "), tail)).when(minutes > 0, tail).otherwise(F.concat(seconds, F.lit("s")))


def progress_line(now_ms: Column) -> Column:
    """A run's progress; completed before failed before cancelled before merging before active.

    Uses columns state, merge_state, cancel_requested, total, done, leased, failed, started_at.
    """
    c = F.col
    ratio = F.concat(c("done"), F.lit("/"), c("total"))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return (
        F.when(c("state") == "completed", say("EPUB complete · ", ratio))
        .when(c("state") == "failed", say("EPUB needs retry · ", ratio, " · ", c("failed"), " failed"))
        .when(c("cancel_requested"), say("EPUB cancellation requested · ", ratio))
        .when(c("merge_state") == "leased", say("EPUB merging · ", ratio))
        .otherwise(say("EPUB translating · ", ratio, " complete · ", c("leased"), " active · ", c("failed"), " failed · ", elapsed(c("started_at"), now_ms)))
    )


# ---- JSON and glossaries


def loose_json(response: Column) -> Column:
    """From the first opening bracket or brace to the last closing one; null if there is none."""
    return F.nullif(F.regexp_extract(response, r"(?s)[\[{].*[\]}]", 0), F.lit(""))


def glossary_text(entries: Column) -> Column:
    """Lines 'source = target # note' of entries (source, target, note); a comment if there are none."""
    kept = F.filter(entries, lambda e: e["source"].isNotNull() & e["target"].isNotNull() & (strip(e["source"]) != ""))
    note = lambda e: F.when(strip(F.coalesce(e["note"], F.lit(""))) != "", F.concat(F.lit(" # "), strip(e["note"]))).otherwise("")
    made = F.transform(kept, lambda e: F.concat(strip(e["source"]), F.lit(" = "), strip(e["target"]), note(e)))
    return F.when(F.size(F.coalesce(made, F.array().cast("array<string>"))) > 0, F.concat(F.array_join(made, "\n"), F.lit("\n"))).otherwise(NO_GLOSSARY)


def count_of(text: Column, part: Column) -> Column:
    """How often part occurs in text, without overlaps."""
    return ((F.char_length(text) - F.char_length(F.replace(text, part, F.lit("")))) / F.char_length(part)).cast("int")


def preview(paths: Column, shown: int = 5) -> Column:
    """The first few, and how many more; 'none' if empty."""
    first = F.array_join(F.slice(paths, 1, shown), ", ")
    return F.when(F.size(paths) > shown, F.concat(first, F.lit(", +"), F.size(paths) - shown, F.lit(" more"))).otherwise(F.coalesce(F.nullif(first, F.lit("")), F.lit("none")))


def lease_token(run_id: Column, job_id: Column, attempt: Column, now: Column) -> Column:
    """A token that differs for each claim and is the same when a step is run again."""
    return F.left(F.sha2(F.concat_ws("|", run_id, job_id.cast("string"), attempt.cast("string"), now.cast("string")), 256), F.lit(32))
