"""The named queries as DuckDB SQL, written independently of the Spark plans."""

from __future__ import annotations

from ..functions.urls import SUFFIXES
from ..operators.pii import EMAIL, IP, PHONE
from .queries import LANGS, LEXICON, PATTERNS, PHRASES, SEARCHED, SPIKES, WORDS

#: RE2 matches in linear time and has no possessive quantifiers and no class intersection.
WORD = r"(?:[\p{L}\p{M}]+(?:[.'’:·][\p{L}\p{M}]+)*|\p{N}+(?:[.'’,;]\p{N}+)*|_+)+"
TOKEN = WORD + r"|[^\s\p{Z}\p{L}\p{N}\p{M}_]"
WORDPUNCT = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
SPACE = r"\r\n|[\t\n\x0B\f\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SCHEME = r"[A-Za-z][A-Za-z0-9+.-]*"


def _s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _tokens(pattern: str = TOKEN, text: str = "text") -> str:
    return f"regexp_extract_all({text}, $re${pattern}$re$)"


def _line(text: str = "text") -> str:
    return f"(' ' || array_to_string({_tokens(WORD, f'lower({text})')}, ' ') || ' ')"


def _grams(n: int) -> str:
    return f"""toks as (select {_tokens()} as t from documents where text is not null),
grams as (select unnest(list_transform(range(1, len(t) - {n} + 2), lambda i: t[i:i+{n - 1}])) as g from toks where len(t) >= {n})"""


def _ranked(n: int, order: str, having: str) -> str:
    return f"""with {_grams(n)}, counted as (select g, count(*) as c from grams group by g having {having}),
ranked as (select *, (row_number() over (order by c {order}, g desc))::integer as r from counted)
select array_to_string(g, ' ') as string, c as count, r as rank from ranked where r <= 20"""


def _stripped(text: str) -> str:
    return rf"regexp_replace({text}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


_NOT_BLANK = r"(text is not null and regexp_matches(text, '[^\s\p{Z}]'))"
_CLEAN = r"regexp_replace(url, '^[\x00-\x20]+|[\t\r\n]', '', 'g')"
_NETLOC = f"regexp_extract({_CLEAN}, '^(?:{SCHEME}:)?//([^/?#]*)', 1)"
_PATH = f"regexp_extract({_CLEAN}, '^(?:{SCHEME}:)?(?://[^/?#]*)?([^?#]*)', 1)"
_EXT = rf"regexp_extract(regexp_extract({_PATH}, '([^/;]*)(?:;[^/]*)?$', 1), '^\.*[^.](?s:.*)\.([^.]*)$', 1)"


def _contains(column: str, *phrases: str) -> list[str]:
    return [f"contains({column}, {_s(f' {p} ')})" for p in phrases]


def _locations() -> str:
    found = " union all ".join(f"select {_s(p)} as pattern, doc_id, regexp_extract_all(text, {_s(p)}) as m, string_split_regex(text, {_s(p)}) as g from documents where text is not null" for p in PATTERNS[:2])
    bytes_of = "coalesce(list_sum(list_transform({}, lambda x: strlen(x))), 0)"
    return f"""with found as ({found}), each as (select *, unnest(range(1, len(m) + 1)) as i from found),
placed as (select pattern, doc_id, m[i] as match, ({bytes_of.format('g[1:i]')} + {bytes_of.format('m[1:i-1]')})::bigint as start from each)
select pattern, doc_id, match, start, start + strlen(match) as "end" from placed"""


def _count_phrases() -> str:
    parts = []
    for p in PHRASES:
        n = len(p.split(" "))
        parts.append(f"select {_s(p)} as string, (select count(*) from (select unnest(list_transform(range(1, len(t) - {n} + 2), lambda i: array_to_string(t[i:i+{n - 1}], ' '))) as g from toks where len(t) >= {n}) where g = {_s(p)}) as count")
    return f"with toks as (select {_tokens()} as t from documents where text is not null) " + " union all ".join(parts)


def _search_regex() -> str:
    return " union all ".join(f"select {_s(p)} as pattern, coalesce(sum(len(regexp_extract_all(text, $re${p}$re$))), 0)::bigint as count from documents where text is not null" for p in PATTERNS)


def _suffixes() -> str:
    rows = ", ".join(f"({_s(r)})" for r in SUFFIXES if r[0] not in "*!")
    return rf"""with hosts as (
  select regexp_replace(lower(regexp_replace(regexp_replace(n, '^.*@', ''), ':\d*$', '')), '\.$', '') as host, c
  from (select {_NETLOC} as n, count(*) as c from pages group by 1)
), ends as (
  select host, c, unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))) as e from hosts
), best as (select host, any_value(c) as c, max_by(e, length(e)) as e from ends where e in (select * from (values {rows})) and host is not null group by host)
select e as high_level_domain, sum(c)::bigint as count from best group by e"""


def _junk() -> str:
    pieces = ["." * 45, "!" * 99, "# # # # # # #", "?" * 7, "," * 76, ":)" * 52, ";" * 121]
    often = [("." * 11, 50), ("/ / / / /", 50), ("%", 1000)]
    return " or ".join(["length(text) > 500000", *(f"contains(text, {_s(p)})" for p in pieces), *(f"(length(text) - length(replace(text, {_s(p)}, ''))) > {len(p) * n}" for p, n in often)])


def _pii() -> str:
    window = "lower(substring(text, (greatest(0, p - 50) + 1)::bigint, greatest(0, p + length(m) + 50 - greatest(0, p - 50))::bigint))"
    url = r"""(regexp_matches(w, '(?:https?://www\.|www\.)[a-zA-Z0-9][a-zA-Z0-9-]*\.[^\s]{2,}') or regexp_matches(replace(w, '://www', '://-'), 'https?://[a-zA-Z0-9](?:[a-zA-Z0-9-]+[a-zA-Z0-9]|[a-zA-Z0-9]*)\.[^\s]{2,}'))"""
    return f"""with docs as (select text, lower(text) as low from documents where {_NOT_BLANK} and not ({_junk()})),
emails as (select unnest(regexp_extract_all(low, $re${EMAIL}$re$, 1)) as m from docs),
phones as (select text, unnest(list_transform(list_zip(regexp_extract_all(low, $re${PHONE}$re$, 1), regexp_extract_all(low, $re${PHONE}$re$, 2), regexp_extract_all(low, $re${PHONE}$re$, 3)), lambda z: z[1] || z[2] || z[3])) as m from docs),
ips as (select text, unnest(regexp_extract_all(low, $re${IP}$re$)) as m from docs),
found as (select 'phone_numbers' as pii, text, m, strpos(text, m) - 1 as p from phones union all select 'IP_addresses', text, m, strpos(text, m) - 1 from ips),
judged as (select pii, {window} as w from found)
select pii, count(*) as count from judged where not (contains(w, 'isbn') or contains(w, 'doi') or contains(w, '#') or (pii = 'phone_numbers' and {url})) group by pii
union all
select * from (select 'email' as pii, count(*) as count from emails where split_part(m, '@', 1) <> '(' and contains(split_part(m, '@', 2), '.')) where count > 0"""


def _profanity() -> str:
    # RE2's word boundary knows ASCII letters only
    plain = r"regexp_replace(text, '[^\x00-\x7F\p{Z}\p{P}\p{S}]', 'q', 'g')"
    parts = []
    for c, words in LEXICON.items():
        inner = r"\b|\b".join(words)
        parts.append(f"len(regexp_extract_all({plain}, $re$(?i)\\b{inner}\\b$re$)) as \"{c}\"")
    profane = '("offensive-minority-reference" + "offensive-not-minority") > 0'
    named = " union all ".join(f"select '{c}' as profanity, sum(\"{c}\")::bigint as count from n where not long" for c in LEXICON)
    return f"""with n as (select length(text) > 99999 as long, {", ".join(parts)} from documents where {_NOT_BLANK})
select * from (select 'long' as profanity, count(*) filter (where long) as count from n union all select 'profane', count(*) filter (where not long and {profane}) from n
union all select 'not profane', count(*) filter (where not long and not {profane}) from n union all {named}) where count > 0"""


def _subsets() -> str:
    parts = []
    for m in range(1, 1 << len(LANGS)):
        own = [x for i, x in enumerate(LANGS) if m >> i & 1]
        both = " intersect ".join(f"select k from keyed where lang = {_s(x)}" for x in own)
        parts.append(f"select {_s(','.join(own))} as datasets, (select count(*) from ({both})) as size")
    return f"with keyed as (select distinct lang, md5(text) as k from documents) select * from ({' union all '.join(parts)}) where size > 0"


_FIRST = "row_number() over (partition by md5(text) order by doc_id) > 1"
_PROBES = f"probes as (select item_id, {_line()} as phrase from benchmark where text is not null), docs as (select doc_id, {_line()} as line from documents where text is not null)"
_HITS = f"{_PROBES}, counted as (select p.item_id, count(d.doc_id) as documents from probes p left join docs d on contains(d.line, p.phrase) and length(p.phrase) > 2 group by 1)"
_PAIRS = """cut as (select item_id, string_split(text, ' ') as t from benchmark),
halves as (select item_id, array_to_string(t[1:ceil(len(t) / 2)::bigint], ' ') as a, array_to_string(t[ceil(len(t) / 2)::bigint + 1:], ' ') as b from cut)"""


def oracle_sql() -> dict[str, str]:
    lengths = f"""select 'chars ' || length(text) as key from documents where text is not null
union all select 'tokens ' || len({_tokens(WORDPUNCT, _stripped("text"))}) from documents where text is not null
union all select 'text is None' from documents where text is null"""
    shown = "replace(text, chr(10), '(newline)')"
    keyed = "select lang, coalesce(md5(text), 'None') as key, count(*) as count from documents group by 1, 2"
    tokens = f"len({_tokens()})"
    return {
        "topk_1gram": _ranked(1, "desc", "count(*) > 1"),
        "topk_3gram": _ranked(3, "desc", "count(*) > 1"),
        "topk_5gram": _ranked(5, "desc", "count(*) > 1"),
        "botk_2gram": _ranked(2, "asc", "count(*) < 4294967295"),
        "unique_ngrams": " union all ".join(f"select {n}::integer as n, unique_count from (with {_grams(n)} select count(distinct g) as unique_count from grams)" for n in (1, 2, 3)),
        "count_phrases": _count_phrases(),
        "search_regex": _search_regex(),
        "corpus_stats": f"select coalesce(sum({tokens}), 0)::bigint as total_tokens, count(*) as total_documents, coalesce(sum(strlen(text)), 0)::bigint as total_bytes, max({tokens}) as document_max_tokens, min({tokens}) as document_min_tokens from documents",
        "search_locations": _locations(),
        "stats_extreme_docs": f"with n as (select doc_id, {tokens} as tokens from documents where text is not null) select 'max' as kind, doc_id, tokens from n where tokens = (select max(tokens) from n) union all select 'min', doc_id, tokens from n where tokens = (select min(tokens) from n)",
        "scheme_counts": f"select lower(regexp_extract({_CLEAN}, '^({SCHEME}):', 1)) as scheme, count(*) as count from pages group by 1",
        "url_counts": f"select {_NETLOC} as url, count(*) as count from pages group by 1",
        "url_token_counts": f"select * from (select {_NETLOC} as url, sum(coalesce(len({_tokens(TOKEN, 'html')}) + len(regexp_extract_all(html, '{SPACE}')), 0))::bigint as count from pages group by 1) where regexp_full_match(url, '\\S+')",
        "public_suffix_counts": _suffixes(),
        "extension_counts": f"select case when lower({_EXT}) in ('jpg', 'png', 'jpeg') then {_EXT} else 'other' end as ext, count(*) as count from pages group by 1",
        "language_counts": f"select case when length(text) > 99999 then 'long' else coalesce(lang, 'un') end as language, count(*) as count from documents where {_NOT_BLANK} group by 1",
        "year_counts": "select coalesce(year(ts)::varchar, 'None') as year, count(*) as count from events group by 1",
        "length_histogram": f"select key, count(*) as count from ({lengths}) group by key",
        "length_distribution": f"with l as (select key, count(*) as c from ({lengths}) group by key), s as (select split_part(key, ' ', 1) as kind, split_part(key, ' ', 2)::bigint as length, c from l where key <> 'text is None') select kind, length, c / sum(c) over (partition by kind)::double as share from s",
        "length_spikes": f"""select key, count(*) as count from (
select len({_tokens(WORDPUNCT, _stripped("text"))}) || ' tok / ' || {shown} as key from documents where text is not null and len({_tokens(WORDPUNCT, _stripped("text"))}) < {SPIKES["token_lengths"].stop}
union all select length(text) || ' char / ' || {shown} from documents where text is not null and length(text) < {SPIKES["char_lengths"].stop}) group by key""",
        "pii_counts": _pii(),
        "profanity_taxonomy": _profanity(),
        "profanity_model": f"select case when length(text) > 99999 then 'long' when toxic = 1 then 'profane' else 'not profane' end as profanity, count(*) as count from documents join labels using (doc_id) where {_NOT_BLANK} group by 1",
        "text_hash_counts": keyed,
        "url_key_counts": "select coalesce(url, 'null') as key, count(*) as count from pages group by 1",
        "duplicate_summary": f"select lang, coalesce(sum(count) filter (where count > 1), 0)::bigint as duplicates, sum(count)::bigint as total, count(*) filter (where count > 1) as uniq_duplicates, count(*) as uniq_total from ({keyed}) group by lang",
        "removed_by_source": f"select coalesce(source, 'no_source') as source, count(*) as removed from (select source, {_FIRST} as gone from documents where text is not null) where gone group by 1",
        "dedup_attributes": f"select doc_id, source, {_FIRST} as contaminated from documents where text is not null",
        "dedup_survivors": f"select doc_id, md5(text) as key from (select doc_id, text, {_FIRST} as gone from documents where text is not null) where not gone",
        "decontaminate_attributes": "select doc_id, source, text in (select text from documents where source = (select min(source) from documents) and text is not null) as contaminated from documents where text is not null",
        "overlap_pairs": "select md5(text) as key from documents where length(source) % 2 = 0 intersect select md5(text) from documents where length(source) % 2 = 1",
        "overlap_powerset": _subsets(),
        "top_duplicate_examples": "select md5(text) as key, count(*) as count, min(doc_id) as doc_id, any_value(length(text)) as n_chars from documents where text is not null group by 1 having count(*) > 1 order by count desc, key desc limit 30",
        "phrase_doc_count": f"select count(*) as documents from documents where {' or '.join(_contains(_line(), *SEARCHED))}",
        "all_phrases_doc_count": f"select count(*) as documents from documents where lang = 'en' and {' and '.join(_contains(_line(), 'the', 'of the'))}",
        "regexp_doc_count": f"select count(*) as documents from documents where len(list_filter({_tokens(WORD, 'lower(text)')}, lambda t: regexp_full_match(t, 'th.{{3,5}}ing') or regexp_full_match(t, 'pap?a'))) > 0",
        "slop_doc_count": f"with d as (select {_tokens(WORD, 'lower(text)')} as t from documents where text is not null) select count(*) as documents from d where len(list_filter(range(1, len(t) + 1), lambda i: t[i] = 'of' and (t[i+1] = 'the' or t[i+2] = 'the' or t[i+3] = 'the' or t[i-1] = 'the' and i > 1))) > 0",
        "phrase_docs": f"select doc_id, lang from documents where {' or '.join(_contains(_line(), *SEARCHED))}",
        "per_phrase_counts": f"with {_HITS} select item_id, documents from counted",
        "unigram_ttf": f"with w as (select unnest({_tokens(WORD, 'lower(text)')}) as term from documents), asked as (select unnest([{', '.join(map(_s, WORDS))}]) as term) select a.term, count(w.term) as count from asked a left join w using (term) group by 1",
        "contamination_pct": f"with {_HITS} select count(*) as n, count(*) filter (where documents > 0) as contaminated, 100.0::double * avg((documents > 0)::integer) as percentage from counted",
        "paired_contamination_pct": f"with {_PAIRS}, docs as (select {_line()} as line from documents where text is not null), counted as (select item_id, exists(select 1 from docs where contains(line, {_line('a')}) and contains(line, {_line('b')})) as hit from halves) select count(*) as n, count(*) filter (where hit) as contaminated, 100.0::double * avg(hit::integer) as percentage from counted",
        "hash_split": "select doc_id, case substring(sha1(coalesce(text, '')), 1, 3) when 'fff' then 'test' when 'ffe' then 'test' when 'ffd' then 'valid' when 'ffc' then 'valid' else 'train' end as split from documents",
        "per_file_limit": "select source, doc_id from (select source, doc_id, row_number() over (partition by source order by doc_id) as r from documents) where r <= 3",
        "most_frequent_values": "with c as (select event_type as value, count(*) as count from events where event_type is not null group by 1) select * from c where count = (select max(count) from c)",
    }
