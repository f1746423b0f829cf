"""SQL fragments the oracles share."""

from presswork.functions import fixed


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def squeeze(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), {q(fixed.SPACE_RE2)}, ' ', 'g'))"


def words(c: str, terms) -> str:
    return f"regexp_matches(coalesce({c}, ''), {q('(?i)(^|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_])(' + '|'.join(terms) + ')([^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]|$)')})"


def isin(c: str, values) -> str:
    return f"({c} IN ({', '.join(q(v) for v in values)}))"


def lookup(c: str, table: dict) -> str:
    return "CASE " + c + " " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + " END"


def netloc(c: str) -> str:
    return f"lower(regexp_extract(coalesce({c}, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"


def domain(c: str) -> str:
    d = f"regexp_replace({netloc(c)}, '^www\\.', '')"
    return f"CASE WHEN {d} = '' THEN 'NA' ELSE {d} END"


def day(c: str) -> str:
    return f"try_strptime(CASE WHEN regexp_matches({c}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN left({c}, 10) END, '%Y-%m-%d')"


def month(ts: str) -> str:
    return f"coalesce(strftime({ts}, '%Y-%m'), 'NaT')"


def blocks(body: str) -> str:
    """List of blocks of a text column."""
    t = f"trim(regexp_replace(coalesce({body}, ''), '\\r\\n?', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13) || chr(12))"
    full = lambda a: f"list_filter({a}, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13) || chr(12)) <> '')"
    by_blank = full(f"regexp_split_to_array({t}, '\\n[ \\t\\r\\f\\x0b]*\\n')")
    parts = f"CASE WHEN len({by_blank}) <= 2 THEN {full(f'string_split({t}, chr(10))')} ELSE {by_blank} END"
    return f"list_filter(list_transform({parts}, lambda x: {squeeze('x')}), lambda x: length(x) >= {fixed.BLOCK_MIN_CHARS})[1:{fixed.BLOCKS_PER_DOC}]"


def suspect(c: str) -> str:
    t = f"coalesce({c}, '')"
    return (
        f"CASE WHEN length({t}) < 25 THEN 1 WHEN {words(c, fixed.MENU_TERMS)} THEN 1 WHEN regexp_matches({t}, {q(fixed.URL_MARKS)}) THEN 1 "
        f"WHEN regexp_matches({t}, {q(fixed.SCRIPT_MARKS)}) THEN 1 WHEN {words(c, fixed.SOCIAL_TERMS)} AND length({t}) < 120 THEN 1 "
        f"WHEN NOT regexp_matches({t}, '[\\p{{L}}\\p{{N}}]') THEN 1 "
        f"WHEN NOT regexp_matches({t}, '[.!?]') AND len(regexp_extract_all({t}, '[A-Za-z]')) < 20 THEN 1 ELSE 0 END")


def length_bucket(n: str) -> str:
    return f"CASE WHEN {n} < 40 THEN 'short' WHEN {n} < 120 THEN 'medium' ELSE 'long' END"


def entity_key(c: str, camel: bool = True) -> str:
    s = squeeze(f"regexp_replace(coalesce({c}, ''), '([a-z])([A-Z])', '\\1 \\2', 'g')") if camel else squeeze(c)
    s = f"regexp_replace(lower({s}), '[''’]', '', 'g')"
    s = f"regexp_replace({s}, '[()\\[\\]{{}}.,;:!?\"“”‘’/\\\\|]+', ' ', 'g')"
    return squeeze(f"regexp_replace({s}, '[-_]+', ' ', 'g')")


def title_case(c: str) -> str:
    w = ("CASE WHEN regexp_matches(w, '^[^a-z]{1,4}$') AND regexp_matches(w, '[A-Z]') THEN w "
         "WHEN regexp_matches(w, '^[A-Za-z]+$') THEN upper(left(w, 1)) || lower(substr(w, 2)) ELSE w END")
    return f"array_to_string(list_transform(string_split({squeeze(c)}, ' '), lambda w: {w}), ' ')"


def canonical(c: str) -> str:
    camel = squeeze(f"regexp_replace(coalesce({c}, ''), '([a-z])([A-Z])', '\\1 \\2', 'g')")
    punct = q(fixed.OUTER_PUNCT)
    s = f"regexp_replace(trim({camel}, {punct}), '(?i)^(the|a|an)\\s+', '')"
    s = squeeze(f"regexp_replace({s}, '(?i)(''s|’s)$', '')")
    k = entity_key(s)
    hit = lookup(k, fixed.SAFE_NAMES)
    return (f"CASE WHEN {hit} IS NOT NULL THEN {hit} WHEN regexp_matches({s}, '^[A-Z]{{2,6}}$') THEN {s} "
            f"WHEN {isin(k, fixed.GENERIC_TECHNOLOGY)} THEN {title_case(k)} ELSE {title_case(s)} END")


def numeric_junk(c: str) -> str:
    s = squeeze(c)
    return (f"(length({s}) <= 1 OR regexp_matches({s}, '^[#$€£¥]?\\d[\\d,.\\-+%/ ]*$') OR regexp_matches({s}, '^[#$€£¥]?[A-Z]*\\d+[A-Z0-9\\-+./% ]*$') "
            f"OR regexp_matches({s}, '(?i)^(#|No\\.?|Booth|Stand)\\s*[A-Z0-9.\\-]+$') OR regexp_matches({s}, '^[$€£¥]\\s*\\d[\\d,.\\-+% ]*$'))")


def tier(c: str) -> str:
    return f"CASE WHEN {c} >= {fixed.HEAD_DOCS} THEN 'head' WHEN {c} >= {fixed.MID_DOCS} THEN 'mid' WHEN {c} >= {fixed.TAIL_DOCS} THEN 'tail' ELSE 'below_tail' END"


def draw(*keys: str, seed: int = 42) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)}))"


def first_matching(c: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce({c}, '')), {q('|'.join(p))}) THEN {q(n)}" for n, p in rules) + " ELSE 'Other' END"
