"""The classification of residue as SQL, from the same fixed values.

RE2 looks neither ahead nor behind: what may not stand before or after a match is matched
itself, or filtered from the matches.
"""

from __future__ import annotations

from docloom.llm import residue

_NOT_IN_WORD = r"[^\p{L}\d_]"


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _has(phrases: tuple[str, ...], whole: bool = False) -> str:
    return f"regexp_matches(message, {_text(rf'(?:^|{_NOT_IN_WORD})(?:' + '|'.join(phrases) + ')' + (rf'(?:$|{_NOT_IN_WORD})' if whole else ''))})"


_SCRIPT = f"({_has((residue.SCRIPT_WORDS,), True)} and regexp_matches(message, {_text('|'.join(residue.SCRIPT_DEMANDS))}))"
_SURE = f"case when {_SCRIPT} then 'script' when {_has(residue.ERROR_PHRASES)} then 'error' when {_has(residue.FILLER_PHRASES)} then 'filler' when regexp_matches(message, {_text(residue.OPEN_FIELD)}) then 'placeholder' end"
_BROAD = f"case when {_has(residue.SCREEN_WORDS, True)} and {_has(residue.TROUBLE_WORDS, True)} then 'error' when {_has(residue.STAND_IN_WORDS, True)} then 'filler' end"
_CERTAIN = r"\{\{[^{}\n]{0,80}\}\}|\{%[^{}\n]{0,80}%\}|\$\{[^{}\n]{0,80}\}|%%\p{L}[\p{L}\d_]{0,40}%%|<<\p{L}[\p{L}\d_ ]{0,40}>>|@@\p{L}[\p{L}\d_]{0,40}@@"
_NAMED = rf"(?:^|{_NOT_IN_WORD})(__\p{{Lu}}[\p{{Lu}}\d_]{{0,40}}?__)(?:$|{_NOT_IN_WORD})"
_TAGS = r"^<(?:html|head|title|body|h\d|p|br|b|i|a|div|span|noscript|script|table|tr|td|ul|li)(?:$|\W)"
_UNSURE = rf"""list_concat(
    list_filter(regexp_extract_all(rest, '\[\p{{L}}[\p{{L}}_ ]{{1,40}}\]\(?'), lambda x: right(x, 1) = ']' and x not in ('[at]', '[dot]', '[punkt]', '[ät]')),
    list_filter(regexp_extract_all(rest, '<\p{{L}}[\p{{L}}_ ]{{1,40}}>'), lambda x: not regexp_matches(x, '{_TAGS}')),
    regexp_extract_all(rest, '«\p{{Lu}}[\p{{L}}_]{{1,40}}»'), regexp_extract_all(rest, '#\p{{Lu}}[\p{{Lu}}_]{{1,40}}#'))"""

_FOUND = rf"""
with v as (
  select concept_id, coalesce(bundle, '') as src, 'body' as field, body as value from concepts where body is not null
  union all select concept_id, coalesce(bundle, ''), 'description', description from concepts where description is not null),
parts as (select concept_id, src, field, unnest(string_split_regex(regexp_replace(value, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+')) as part from v),
msg as (
  select concept_id, src, field, trim(regexp_replace(regexp_replace(regexp_replace(lower(part), '(^|\s)(?:https?://\S{{1,300}}|www\.\S{{1,300}}|[^\s@]{{1,100}}@\S{{1,200}})', '\1<at>', 'g'), '\d+(?:[.,:/\-]\d+)*', '0', 'g'), '\s+', ' ', 'g')) as message from parts),
ruled as (select concept_id, src, field, message, {_SURE} as sure, {_BROAD} as broad from msg),
cut as (select *, regexp_replace(regexp_replace(value, '{_CERTAIN}', ' ', 'g'), '{_NAMED}', ' ', 'g') as rest from v),
spans as (
  select concept_id, src, field, unnest(list_concat(regexp_extract_all(value, '{_CERTAIN}'), regexp_extract_all(value, '{_NAMED}', 1))) as part, true as certain from v
  union all select concept_id, src, field, unnest({_UNSURE}), false from cut),
found as (
  select distinct concept_id, src, field, coalesce(sure, broad) as kind, sure is not null as certain, message from ruled where coalesce(sure, broad) is not null
  union select concept_id, src, field, 'placeholder', certain, trim(regexp_replace(lower(part), '\|.*|[^\p{{L}}\d ]+', ' ', 'g')) from spans),
stats as (select kind, message, count(*) as n_rows, count(distinct src) as n_sources, bool_or(certain) as sure_elsewhere from found group by all),
bad as (
  select concept_id, field, kind, message, case when wide then 'recurring' else 'phrase' end as path, n_rows, n_sources
  from found join (select *, n_rows >= {residue.WIDE_ROWS} and n_sources >= {residue.WIDE_SHARE} * (select count(distinct coalesce(bundle, '')) from concepts) as wide from stats) using (kind, message) where wide or certain or sure_elsewhere)
"""

ORACLE = {
    "p2_bad": _FOUND + "select * from bad",
    "p2_found": _FOUND + "select distinct concept_id, field from bad",
    "p2_paths": _FOUND + "select kind, path, count(distinct concept_id || field) as n_values, count(distinct message) as n_messages from bad group by all",
    "p2_clean": _FOUND
    + """, flags as (select concept_id, list(distinct field) as fs from bad group by 1)
    select concept_id, case when coalesce(list_contains(fs, 'body'), false) then null else body end as body, case when coalesce(list_contains(fs, 'description'), false) then null else description end as description
    from concepts left join flags using (concept_id)""",
}
