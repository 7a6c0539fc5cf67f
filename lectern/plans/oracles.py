"""DuckDB SQL of regions, sentences and formatted texts, written apart from the operators, for results to be held against.

Regular expressions there have no look-around and white space is ASCII's, so sentence ends are found on a string of
character classes of the same length, from which ends that do not hold are taken away step by step; regions are a
recursive fold over lines.  Each function gives a list of common table expressions.
"""

from __future__ import annotations

from lectern.functions import text as tx
from lectern.functions.abbreviations import DOTTED, LANGS, WORDS
from lectern.operators import sentences as rules

#: White space of all kinds, as a list of characters and inside a class.
WHITE = " || ".join(f"chr({ord(c)})" for c in tx.WHITE)
W = r"\s\x0b\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
LINES = r"string_split(regexp_replace({0}, '\r?\n\z', ''), chr(10))"
UNIFIED = "replace({0}, chr(13) || chr(10), chr(10))"
TOKENS = "|".join(t.replace(r"\S", rf"[^{W}]").replace(r"[^.\s", rf"[^.{W}").replace("'", "''") for t in rules.TOKENS)


def _ranges(chars: str) -> str:
    """A class of the operators in this dialect."""
    import re

    return re.sub(r"\\u([0-9A-Fa-f]{4})", r"\\x{\1}", chars)


#: Classes of characters in the order they are told apart; each becomes one private character.
CLASSES = (
    ("s", f"[{_ranges(rules._S)}]"), ("a", f"[{_ranges(rules._A)}]"), ("g", f"[{_ranges(rules._GOES_ON)}]"), ("q", r"\r"), ("r", r"[\n\x{0085}\x{2028}\x{2029}]"),
    ("p", r"[\p{Zs}\t\x0B\x0C]"), ("x", r"[\p{Mn}\p{Mc}\p{Me}\p{Cf}]"), ("c", r"""[\p{Ps}\p{Pe}\p{Pi}\p{Pf}"'']"""), ("l", r"\p{Ll}"), ("u", r"[\p{Lu}\p{Lt}]"),
    ("o", r"[\p{L}\p{Nl}]"), ("n", r"\p{Nd}"), ("d", r"\p{N}"), ("z", r"[^\x{E100}-\x{E1FF}]"),
)
_TAIL = "x*(?:cx*)*(?:px*)*"
#: What takes an end away: a figure or a capital right behind a period, a mark that goes on, a small letter further on.
STEPS = (
    ("a(x*n)", r"b\1"), ("([ul])a(u)", r"\1b\2"), ("([ul])a(u)", r"\1b\2"),
    (f"a({_TAIL}[gabst])", r"b\1"), (f"a({_TAIL}[gabst])", r"b\1"), (f"s({_TAIL}[gabst])", r"t\1"), (f"s({_TAIL}[gabst])", r"t\1"),
    ("a([^uolrqabst]*l)", r"b\1"), (f"([as]{_TAIL}(?:qr|q|r)?|qr|q|r)", r"\1|"),
)


def _chain(value: str, steps: tuple[tuple[str, str], ...]) -> str:
    for pattern, to in steps:
        value = f"regexp_replace({value}, '{pattern}', '{to}', 'g')"
    return value


def _classes(value: str) -> str:
    """Private characters first, as letters that stand for classes are characters themselves; then the letters."""
    private = {name: f"\\x{{E1{n:02X}}}" for n, (name, _) in enumerate(CLASSES)}
    for n, (_, pattern) in enumerate(CLASSES):
        value = f"regexp_replace({value}, '{pattern}', chr({0xE100 + n}), 'g')"
    return f"translate({value}, {' || '.join(f'chr({0xE100 + n})' for n in range(len(private)))}, '{''.join(private)}')"


def _is_abbreviated(end: str) -> str:
    space = rf"[{W}]"
    out = "CASE lang"
    for lang in LANGS[1:]:
        out += f" WHEN '{lang}' THEN {_tail(end, lang, space)}"
    out += f" ELSE {_tail(end, 'en', space)} END"
    before = f"{end}[length({end}) - length(w) - 1]"
    extra = f"len(list_filter(coalesce(extras, []), lambda w: w <> '' AND ends_with({end}, w || '.') AND (length({end}) = length(w) + 1 OR regexp_matches({before}, '^{space}')))) > 0"
    return f"(ends_with({end}, '.') AND ({out} OR {extra}))"


def _tail(end: str, lang: str, space: str) -> str:
    words, dotted = "|".join(WORDS[lang]), "|".join(x.replace(".", "[.]") for x in DOTTED[lang])
    return rf"""regexp_matches(right({end}, 32), '(?:(?:^|{space}|["''`(\[])(?:{words})|(?:^|{space})(?:{dotted}))[.]$')"""


def sentences(source: str, name: str = "sent") -> str:
    """``name(id, no, sentence)`` of ``source(id, text, lang, extras)``; ``id`` may be of any type."""
    return rf"""
{name}_t AS (SELECT id, lang, extras, trim(replace(replace(text, chr(0), ''), chr(1), ''), {WHITE}) AS t FROM {source} WHERE text IS NOT NULL),
{name}_p AS (SELECT *, regexp_extract_all(t, '{TOKENS}') AS toks, string_split_regex(t, '{TOKENS}') AS parts FROM {name}_t WHERE t <> ''),
{name}_c AS (SELECT id, lang, extras, t,
    array_to_string(list_transform(list_zip(parts, toks), lambda x: x[1] || coalesce(repeat(chr(57344), length(x[2])), '')), '') AS m,
    array_to_string(list_transform(list_zip(list_transform(parts, lambda y: {_classes("y")}), toks), lambda x: x[1] || coalesce('z' || repeat('u', length(x[2]) - 2) || 'z', '')), '') AS c
  FROM {name}_p),
{name}_l AS (SELECT *, list_transform(string_split({_chain("c", STEPS)}, '|'), lambda x: length(x)) AS n FROM {name}_c),
{name}_u AS (SELECT id, lang, extras, t, m, c, n, unnest(range(1, len(n) + 1)) AS i FROM {name}_l),
{name}_s AS (SELECT id, lang, extras, i, CAST(n[i] AS BIGINT) AS size, CAST(coalesce(list_sum(n[1:i - 1]), 0) AS BIGINT) AS pos, t, m, c FROM {name}_u),
{name}_g AS (SELECT id, lang, extras, i, t[pos + 1:pos + size] AS seg, m[pos + 1:pos + size] AS mask, c[pos + 1:pos + size] AS cls FROM {name}_s),
{name}_k AS (SELECT * FROM {name}_g WHERE regexp_matches(cls, '[uolnd]')),
{name}_a AS (SELECT *, {_is_abbreviated(f"rtrim(mask, {WHITE})")} AS joins FROM {name}_k),
{name}_b AS (SELECT *, lag(joins, 1, false) OVER (PARTITION BY id ORDER BY i) AS joined FROM {name}_a),
{name}_d AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY i) AS grp FROM {name}_b),
{name}_e AS (SELECT id, grp, string_agg(seg, '' ORDER BY i) AS seg, string_agg(mask, '' ORDER BY i) AS mask FROM {name}_d GROUP BY id, grp),
{name}_f AS (SELECT *, regexp_matches(rtrim(mask, {WHITE}), '[.!?]["'')\]]+$') AND regexp_matches(lead(mask) OVER (PARTITION BY id ORDER BY grp), '^[{W}]*\p{{Ll}}') AS joins FROM {name}_e),
{name}_h AS (SELECT *, coalesce(lag(joins) OVER (PARTITION BY id ORDER BY grp), false) AS joined FROM {name}_f),
{name}_j AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY grp) AS grp2 FROM {name}_h),
{name}_o AS (SELECT id, grp2, trim(string_agg(seg, '' ORDER BY grp), {WHITE}) AS sentence FROM {name}_j GROUP BY id, grp2
  UNION ALL SELECT id, 1, t FROM {name}_p WHERE id NOT IN (SELECT id FROM {name}_k)),
{name} AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY grp2) - 1 AS INT) AS no, sentence FROM {name}_o WHERE sentence <> '')"""


_ENV = r"[\p{L}\p{N}_]+\*?"
_KEPT = ", ".join(f"'{x}'" for x in tx.KEPT_ENVIRONMENTS)
_UNDERLINE = r'==+|--+|~~+|\^\^+|""+|##+|\*\*+|\+\++'


def regions(source: str, name: str = "reg", marker: str = tx.MARKER) -> str:
    """``name(id, region_no, kind, text)`` of ``source(id, text, format)``; null and empty texts have none."""
    return rf"""
{name}_t AS (SELECT id, coalesce(format, 'plaintext') AS fmt, {UNIFIED.format("text")} AS text FROM {source} WHERE text IS NOT NULL AND text <> ''),
{name}_x AS (SELECT id, fmt, unnest(list_zip(range(0, len(a)), a)) AS x FROM (SELECT id, fmt, {LINES.format("text")} AS a FROM {name}_t)),
{name}_y AS (SELECT id, fmt, CAST(x[1] AS INT) AS n, x[2] AS line, trim(x[2], {WHITE}) AS bare, ltrim(x[2], {WHITE}) AS start,
    CAST(strlen(x[2]) - strlen(ltrim(x[2], {WHITE})) AS INT) AS ind FROM {name}_x),
{name}_l AS (SELECT *, regexp_extract(bare, '^(?:[#%] [{W}]*)?{marker}:(on|off)$|^<!-- [{W}]*{marker}:(on|off)[{W}]* -->$', 1) || regexp_extract(bare, '^<!-- [{W}]*{marker}:(on|off)[{W}]* -->$', 1) AS switch,
    regexp_extract(start, '^(`{{3,}}|~{{3,}})', 1) AS fence, lead(bare, 1, '') OVER w AS next_bare,
    coalesce(first_value(CASE WHEN bare <> '' THEN ind END IGNORE NULLS) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS next_ind,
    regexp_extract(line, '^(#{{1,6}}[{W}]+)', 1) AS heading, regexp_extract(line, '^([{W}]*(?:[-*+]|\p{{Nd}}+[.)]) )', 1) AS md_item,
    regexp_extract(line, '^(\*+[{W}]+(?:(?:TODO|DONE|NEXT|WAIT)[{W}]+)?)', 1) AS headline, regexp_extract(line, '^([{W}]*(?:[-+]|\p{{Nd}}+[.)]) )', 1) AS org_item,
    regexp_extract(line, '^[{W}]*\\begin\{{([^}}]+)\}}', 1) AS org_env, regexp_extract(line, '^[{W}]*\\end\{{([^}}]+)\}}', 1) AS org_env_end,
    regexp_extract(line, '\\begin\{{({_ENV})\}}', 1) AS env, regexp_extract(line, '\\end\{{({_ENV})\}}', 1) AS env_end, regexp_matches(line, '\\\][{W}]*$') AS shut
  FROM {name}_y WINDOW w AS (PARTITION BY id ORDER BY n)),
{name}_fold AS (
  SELECT DISTINCT id, -1 AS n, false AS off, CASE WHEN fmt = 'latex' THEN 'preamble' ELSE '' END AS span, '' AS arg, 0 AS dep, CAST(NULL AS INT) AS depth, false AS nl,
    '' AS act, '' AS prefix, '' AS body, '' AS line FROM {name}_l
  UNION ALL
  SELECT id, n, CASE WHEN what = 'switch' THEN switch = 'off' ELSE off END,
    CASE WHEN what IN ('switch', 'held') THEN span WHEN what LIKE 'open_%' THEN what[6:] ELSE '' END,
    CASE what WHEN 'open_front' THEN bare WHEN 'open_fence' THEN fence[1] WHEN 'open_orgenv' THEN org_env WHEN 'open_env' THEN env ELSE arg END,
    CASE what WHEN 'open_fence' THEN CAST(length(fence) AS INT) WHEN 'open_body' THEN ind + 3 WHEN 'open_literal' THEN next_ind ELSE dep END,
    CASE WHEN what IN ('blank', 'prose') THEN NULL WHEN what = 'org_item' THEN CAST(strlen(org_item) AS INT) ELSE depth END,
    CASE WHEN what IN ('headline', 'org_item', 'cont', 'heading') THEN true WHEN what IN ('prose', 'blank', 'item') THEN false ELSE line = '' END,
    CASE WHEN what IN ('headline', 'org_item', 'heading', 'item') THEN CASE WHEN what = 'item' THEN 'item' ELSE 'titled' END WHEN what IN ('prose', 'blank', 'cont') THEN what ELSE 'keep' END,
    CASE what WHEN 'heading' THEN heading WHEN 'item' THEN md_item WHEN 'headline' THEN headline WHEN 'org_item' THEN org_item ELSE '' END,
    CASE what WHEN 'heading' THEN line[length(heading) + 1:] WHEN 'item' THEN line[length(md_item) + 1:] WHEN 'headline' THEN line[length(headline) + 1:]
      WHEN 'org_item' THEN line[length(org_item) + 1:] WHEN 'cont' THEN bare WHEN 'prose' THEN CASE WHEN fmt = 'rst' THEN start ELSE bare END ELSE '' END, line
  FROM (SELECT l.*, f.off, f.span, f.arg, f.dep, f.depth, CASE
      WHEN l.switch <> '' THEN 'switch' WHEN f.off THEN 'held'
      WHEN span = 'front' THEN CASE WHEN l.bare = arg THEN 'close' ELSE 'held' END
      WHEN span = 'fence' THEN CASE WHEN l.fence[1] = arg AND length(l.fence) >= dep THEN 'close' ELSE 'held' END
      WHEN span = 'block' THEN CASE WHEN upper(l.start[1:6]) = '#+END_' THEN 'close' ELSE 'held' END
      WHEN span = 'drawer' THEN CASE WHEN upper(l.bare) = ':END:' THEN 'close' ELSE 'held' END
      WHEN span = 'orgenv' THEN CASE WHEN l.org_env_end = arg THEN 'close' ELSE 'held' END
      WHEN span = 'orgmath' THEN CASE WHEN l.bare = '\]' THEN 'close' ELSE 'held' END
      WHEN span = 'preamble' THEN CASE WHEN contains(l.line, '\begin{{document}}') THEN 'close' ELSE 'held' END
      WHEN span = 'env' THEN CASE WHEN l.env_end = arg THEN 'close' ELSE 'held' END
      WHEN span = 'math' THEN CASE WHEN l.shut THEN 'close' ELSE 'held' END
      WHEN span IN ('body', 'literal') AND (l.bare = '' OR l.ind >= dep) THEN 'held'
      WHEN l.fmt = 'markdown' THEN CASE WHEN l.n = 0 AND l.bare IN ('---', '+++') THEN 'open_front' WHEN l.fence <> '' THEN 'open_fence' WHEN l.bare = '' THEN 'blank'
        WHEN l.heading <> '' THEN 'heading' WHEN length(l.bare) > 1 AND l.bare[1] = '|' AND l.bare[-1] = '|' THEN 'keep' WHEN l.md_item <> '' THEN 'item' ELSE 'prose' END
      WHEN l.fmt = 'org' THEN CASE WHEN upper(l.start[1:8]) = '#+BEGIN_' THEN 'open_block' WHEN strlen(l.bare) > 2 AND l.bare[1] = ':' AND l.bare[-1] = ':' THEN 'open_drawer'
        WHEN l.org_env <> '' THEN 'open_orgenv' WHEN l.bare = '\[' THEN 'open_orgmath' WHEN starts_with(l.bare, '@@') AND regexp_matches(l.bare, '@@[a-zA-Z]+:[^@]*@@') THEN 'keep'
        WHEN l.bare = '' THEN 'blank' WHEN upper(l.start[1:6]) <> '#+END_' AND regexp_matches(l.start, '^(?:#|\||file:|https?://)') THEN 'keep'
        WHEN l.headline <> '' THEN 'headline' WHEN l.org_item <> '' THEN 'org_item' WHEN depth IS NOT NULL AND l.ind >= depth AND f.nl THEN 'cont' ELSE 'prose' END
      WHEN l.fmt = 'latex' THEN CASE WHEN l.bare = '' THEN 'blank' WHEN starts_with(l.bare, '%') OR contains(l.line, '\end{{document}}') THEN 'keep'
        WHEN l.env IN ({_KEPT}) THEN CASE WHEN l.env_end = l.env THEN 'keep' ELSE 'open_env' END
        WHEN starts_with(l.start, '\[') THEN CASE WHEN l.shut THEN 'keep' ELSE 'open_math' END ELSE 'prose' END
      WHEN l.fmt = 'rst' THEN CASE WHEN l.bare = '' THEN 'blank' WHEN starts_with(l.start, '.. ') THEN CASE WHEN contains(l.start, '::') THEN 'open_body' ELSE 'keep' END
        WHEN regexp_full_match(l.bare, '{_UNDERLINE}') OR regexp_full_match(l.next_bare, '{_UNDERLINE}') OR regexp_full_match(l.start, ':[^:]+:.+') THEN 'keep'
        WHEN ends_with(l.start, '::') THEN CASE WHEN l.next_ind > 0 THEN 'open_literal' ELSE 'keep' END WHEN regexp_matches(l.start, '^[|+]') THEN 'keep' ELSE 'prose' END
      WHEN l.bare = '' THEN 'blank' ELSE 'prose' END AS what
    FROM {name}_fold f JOIN {name}_l l ON l.id = f.id AND l.n = f.n + 1)),
{name}_m AS (SELECT *, lag(act) OVER (PARTITION BY id ORDER BY n) AS before FROM {name}_fold WHERE n >= 0),
{name}_q AS (SELECT *, sum(CASE WHEN act = 'cont' OR act = 'prose' AND before IN ('prose', 'item') THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY n) AS grp FROM {name}_m),
{name}_r AS (SELECT id, grp, arg_min(act, n) AS act, arg_min(prefix, n) AS prefix, arg_min(line, n) AS line, coalesce(string_agg(body, ' ' ORDER BY n) FILTER (WHERE body <> ''), '') AS body FROM {name}_q GROUP BY id, grp),
{name}_s AS (SELECT id, grp, unnest(CASE act WHEN 'keep' THEN [struct_pack(o := 0, kind := 'structure', text := line || chr(10))] WHEN 'blank' THEN [struct_pack(o := 0, kind := 'blank', text := line || chr(10))]
    WHEN 'prose' THEN [struct_pack(o := 0, kind := 'prose', text := body)]
    ELSE [struct_pack(o := 0, kind := 'structure', text := prefix), struct_pack(o := 1, kind := 'prose', text := body), struct_pack(o := 2, kind := 'structure', text := chr(10))] END) AS r FROM {name}_r),
{name} AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY grp, r.o) - 1 AS INT) AS region_no, r.kind AS kind, r.text AS text FROM {name}_s WHERE r.kind <> 'prose' OR r.text <> '')"""


def formatted(source: str, name: str = "form") -> str:
    """``name(id, text, formatted)`` of ``source(id, text, format, lang, extras)``, without a width."""
    ended = "CASE WHEN ends_with(text, chr(10)) THEN CASE WHEN ends_with(o, chr(10)) THEN o ELSE o || chr(10) END ELSE regexp_replace(o, '\\n+\\z', '') END"
    return f"""{regions(source, f"{name}_reg")},
{name}_src AS (SELECT struct_pack(a := r.id, b := r.region_no) AS id, r.text, s.lang, s.extras FROM {name}_reg r JOIN {source} s ON s.id = r.id WHERE r.kind = 'prose'),
{sentences(f"{name}_src", f"{name}_sent")},
{name}_one AS (SELECT id.a AS a, id.b AS b, string_agg(sentence, chr(10) ORDER BY no) AS body FROM {name}_sent GROUP BY id),
{name}_two AS (SELECT r.id, r.region_no, r.kind, r.text, o.body, lead(r.kind = 'structure' AND r.text = chr(10), 1, false) OVER (PARTITION BY r.id ORDER BY r.region_no) AS inline
  FROM {name}_reg r LEFT JOIN {name}_one o ON o.a = r.id AND o.b = r.region_no),
{name}_cat AS (SELECT id, string_agg(CASE WHEN kind = 'prose' THEN CASE WHEN body IS NULL THEN '' WHEN inline THEN body ELSE body || chr(10) END ELSE text END, '' ORDER BY region_no) AS o FROM {name}_two GROUP BY id),
{name}_end AS (SELECT s.id, s.text, CASE WHEN s.text IS NULL THEN NULL ELSE coalesce(c.o, '') END AS o FROM {source} s LEFT JOIN {name}_cat c USING (id)),
{name} AS (SELECT id, text, CASE WHEN contains(text, chr(13) || chr(10)) THEN replace({ended}, chr(10), chr(13) || chr(10)) ELSE {ended} END AS formatted FROM {name}_end)"""
