"""SQL text fragments used by the independent checks."""

from clausegrid import constants as K


def norm_page(x: str) -> str:
    t = f"replace({x}, '-' || chr(10), chr(64976))"
    t = f"regexp_replace({t}, '^[\\x{{fdd0}}{K.WS}]+', '')"
    t = f"regexp_replace({t}, '[{K.WS}]+\\z', '')"
    t = f"regexp_replace({t}, '[{K.WS_NO_NEWLINE}]*\\n[{K.WS}]*', chr(10), 'g')"
    t = f"regexp_replace({t}, '[{K.WS_NO_NEWLINE}]+', ' ', 'g')"
    return f"replace({t}, chr(64976), '')"


def norm_compare(x: str) -> str:
    quotes = K.COMPARE_FROM
    to = K.COMPARE_TO.replace("'", "''")
    return f"lower(trim(regexp_replace(translate({x}, '{quotes}', '{to}'), '[{K.WS}]+', ' ', 'g')))"


def trim_ws(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{K.WS}]+', ''), '[{K.WS}]+\\z', '')"


def clause_type(title: str, body: str) -> str:
    arms = " ".join(
        f"WHEN regexp_matches(coalesce({title}, ''), '{p}') OR regexp_matches({body}, '{p}') THEN '{name}'"
        for p, name in K.CLAUSE_TYPES)
    return f"CASE {arms} END"


def esc(pattern: str) -> str:
    return pattern.replace(r"\s", f"[{K.WS}]").replace("'", "''")


def lint_clean(x: str) -> str:
    return "NOT (" + " OR ".join(f"regexp_matches(coalesce({x}, ''), '{esc(p)}')" for p, _ in K.LINT_PATTERNS) + ")"


def grams(x: str) -> str:
    return f"list_transform(range(1, greatest(length({x}), 1)), lambda i: substr({x}, i, 2))"


def dice(na: str, nb: str) -> str:
    """Dice of two normalised columns of one row (short texts)."""
    return (
        f"CASE WHEN {na} = {nb} THEN 1.0::DOUBLE WHEN length({na}) < 2 OR length({nb}) < 2 THEN 0.0::DOUBLE ELSE "
        f"2.0::DOUBLE * coalesce(list_sum(list_transform(map_entries(histo_a), lambda e: least(e.value, coalesce(map_extract_value(histo_b, e.key), 0)))), 0) "
        f"/ (length({na}) + length({nb}) - 2) END"
    )


def dice_table(source: str, key: str, na: str, nb: str) -> str:
    """Dice per key for a relation with two normalised columns, by counting grams in rows."""
    return f"""
SELECT f.{key} AS {key}, CASE WHEN f.{na} = f.{nb} THEN 1.0::DOUBLE WHEN length(f.{na}) < 2 OR length(f.{nb}) < 2 THEN 0.0::DOUBLE
       ELSE 2.0::DOUBLE * coalesce(s.shared, 0) / (length(f.{na}) + length(f.{nb}) - 2) END AS score
FROM {source} f LEFT JOIN (
  SELECT {key}, sum(least(l, r)) AS shared FROM (
    SELECT {key}, g, sum(l) AS l, sum(r) AS r FROM (
      SELECT {key}, unnest({grams(na)}) AS g, 1 AS l, 0 AS r FROM {source}
      UNION ALL SELECT {key}, unnest({grams(nb)}) AS g, 0 AS l, 1 AS r FROM {source}) GROUP BY {key}, g)
  GROUP BY {key}) s ON s.{key} = f.{key}"""


def content_words(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in K.STOP_WORDS)
    return f"list_distinct(list_filter(string_split_regex({norm_compare(x)}, '[^a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains([{stop}], w)))"


def numeric_ok(value: str, quote: str) -> str:
    words = ", ".join(f"{{'w': '{w}', 'd': '{d}'}}" for w, d in K.NUMBER_WORDS)
    clean = "regexp_replace(replace(n, ',', ''), '\\.$', '')"
    digits = f"ltrim(regexp_extract({clean}, '^[0-9]+'), '0')"
    whole = f"CASE WHEN {digits} = '' THEN '0' ELSE {digits} END"
    low = f"lower(translate({quote}, '‘’', ''''''))"
    in_quote = f"list_transform(regexp_extract_all({quote}, '[0-9][0-9,\\.]*'), lambda q: replace(q, ',', ''))"
    spelled = f"list_transform(list_filter([{words}], lambda p: contains({low}, p.w)), lambda p: p.d)"
    return (
        f"len(list_filter(regexp_extract_all({value}, '[0-9][0-9,\\.]*'), lambda n: NOT (list_contains({in_quote}, {clean}) "
        f"OR list_contains({in_quote}, {whole}) OR list_contains({spelled}, {whole}) OR contains({low}, {clean})))) = 0")


def unit(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


def blend(self_report: str, agreement: str, match: str, ocr: str, conflicting: str | None = None) -> str:
    c = f"(0.5::DOUBLE * {unit(self_report)} + 0.3::DOUBLE * {unit(agreement)} + 0.2::DOUBLE * {unit(match)})"
    c = f"(CASE WHEN {ocr} THEN {c} * 0.8::DOUBLE ELSE {c} END)"
    if conflicting:
        c = f"(CASE WHEN {conflicting} THEN {c} * 0.85::DOUBLE ELSE {c} END)"
    return f"floor({c} * 1000 + 0.5::DOUBLE) / 1000.0::DOUBLE"


def fnv_dimension(token: str, dim: int) -> str:
    h = (f"list_reduce(list_transform(string_split({token}, ''), lambda c: CAST(ascii(c) AS BIGINT)), "
         f"lambda h, c: (xor(h, c) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT))")
    return f"CAST(abs(CASE WHEN {h} >= 2147483648 THEN {h} - 4294967296 ELSE {h} END) % {dim} AS INTEGER)"
