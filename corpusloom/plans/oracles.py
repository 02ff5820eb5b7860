"""The same results in DuckDB's SQL, written from the definitions, for the queries that SQL can express."""

from __future__ import annotations

from ..functions.rounding import exact_round_sql
from ..operators.annotate import LEXICON, SENTENCE, TOKEN

R = exact_round_sql


def _listed(names) -> str:
    return ", ".join("'" + n.replace("'", "''") + "'" for n in names)


_POS = " ".join(f"when low in ({_listed(w)}) then '{tag}'" for tag, w in LEXICON.items())
WORDS = r"""
words as (select doc_id, w as word, p as pos from (
  select doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) as w,
         unnest(range(len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')))) as p from documents) where regexp_full_match(w, '\p{L}+')),
freqs as (select word, count(*) as freq from words group by word)"""
SENTENCES = rf"""
sent as (select doc_id, s as sentence, (i - 1)::int as sent_id from (
  select doc_id, unnest(list_filter(regexp_extract_all(text, '{SENTENCE}'), lambda x: regexp_matches(x, '\S'))) as s,
         generate_subscripts(list_filter(regexp_extract_all(text, '{SENTENCE}'), lambda x: regexp_matches(x, '\S')), 1) as i from documents))"""
TOKENS = rf"""{SENTENCES},
raw as (select doc_id, sent_id, unnest(regexp_extract_all(sentence, '{TOKEN}')) as text, generate_subscripts(regexp_extract_all(sentence, '{TOKEN}'), 1) as k from sent),
numbered as (select doc_id, sent_id, (row_number() over (partition by doc_id order by sent_id, k) - 1)::int as tok_id, text, lower(text) as low from raw),
tagged as (select *, case when not regexp_matches(low, '[\p{{L}}\p{{N}}]') then 'PUNCT' when regexp_full_match(low, '\p{{N}}+') then 'NUM' {_POS}
  when regexp_matches(low, 'ly$') then 'ADV' when regexp_matches(low, '(ed|ing|ize|ise)$') then 'VERB' when regexp_matches(low, '(ous|ful|ive|able|ible|al|ic)$') then 'ADJ' else 'NOUN' end as pos from numbered),
seen as (select *, coalesce(min(tok_id) filter (where pos = 'VERB') over s, min(tok_id) filter (where pos = 'AUX') over s, min(tok_id) filter (where pos <> 'PUNCT') over s, min(tok_id) over s) as root,
  max(case when pos = 'VERB' then tok_id end) over b as verb, max(case when pos = 'ADP' then tok_id end) over b as adp, max(case when pos in ('NOUN', 'VERB') then tok_id end) over b as lex,
  min(case when pos = 'NOUN' then tok_id end) over a as noun, lag(pos) over o as pos1, lag(low) over o as low1 from tagged
  window s as (partition by doc_id, sent_id), o as (partition by doc_id, sent_id order by tok_id),
    b as (partition by doc_id, sent_id order by tok_id rows between unbounded preceding and 1 preceding), a as (partition by doc_id, sent_id order by tok_id rows between 1 following and unbounded following)),
tok as (select doc_id, sent_id, tok_id, text,
  case when length(low) > 5 and low like '%ing' then low[:-4] when length(low) > 4 and low like '%ed' then low[:-3] when length(low) > 3 and low like '%s' and low not like '%ss' then low[:-2] else low end as lemma,
  pos, case when tok_id = root then 'ROOT'
    when pos = 'VERB' then case when pos1 = 'CCONJ' then 'conj' when pos1 = 'SCONJ' or low1 = 'that' then 'ccomp' when low1 = 'to' then 'xcomp' else 'advcl' end
    when pos in ('NOUN', 'PRON') then case when adp is not null and (lex is null or lex < adp) then 'pobj' when tok_id < root then 'nsubj' else 'dobj' end
    else case pos when 'ADV' then 'advmod' when 'AUX' then 'aux' when 'CCONJ' then 'cc' when 'SCONJ' then 'mark' when 'PUNCT' then 'punct' when 'ADP' then 'prep' when 'DET' then 'det' when 'ADJ' then 'amod' else 'nummod' end end as dep,
  case when tok_id = root then tok_id when pos = 'ADP' then coalesce(verb, root)
    when pos in ('NOUN', 'PRON') then case when adp is not null and (lex is null or lex < adp) then adp when tok_id < root then root else coalesce(verb, root) end
    when pos in ('DET', 'ADJ', 'NUM') then coalesce(noun, root) else root end as head_id,
  regexp_full_match(text, '\p{{L}}+') as is_alpha, pos = 'PUNCT' as is_punct, false as is_space from seen)"""
DENSITY = """
dens as (select doc_id, sent_id, count(*) filter (where not is_punct) as token_count, count(*) filter (where not is_punct and pos in ('NOUN', 'VERB', 'ADJ', 'ADV')) as content_count,
  case when count(*) filter (where not is_punct) > 0 then (count(*) filter (where not is_punct and pos in ('NOUN', 'VERB', 'ADJ', 'ADV')))::double / count(*) filter (where not is_punct) end as lexical_density
  from tok group by doc_id, sent_id)"""
SUB = "dep in ('advcl', 'ccomp', 'xcomp')"
CLAUSES = f"""
cl0 as (select doc_id, sent_id, count(*) filter (where dep = 'ROOT') as main, count(*) filter (where {SUB}) as subordinate, count(*) filter (where dep = 'conj') as coordinate from tok group by doc_id, sent_id),
cl as (select doc_id, sent_id, main, subordinate, coordinate, {R("case when main > 0 then subordinate::double / main else 0 end")} as subordination_ratio, {R("case when main > 0 then coordinate::double / main else 0 end")} as coordination_ratio from cl0)"""
#: Each token with itself and all its ancestors, however deep.
TREE = """
tree(doc_id, sent_id, tok_id, a, d) as (select doc_id, sent_id, tok_id, tok_id, 0 from tok
  union all select x.doc_id, x.sent_id, x.tok_id, h.head_id, x.d + 1 from tree x join tok h on x.doc_id = h.doc_id and x.a = h.tok_id where h.head_id <> h.tok_id)"""
DEPTHS = TREE + """,
deep as (select doc_id, sent_id, tok_id, max(d) as d from tree group by doc_id, sent_id, tok_id),
dp as (select doc_id, sent_id, max(d) as max_depth, sum(d)::double / count(*) as mean_depth, median(d)::double as median_depth, sum(d)::double / count(*) - median(d)::double as depth_skew from deep group by doc_id, sent_id)"""
DEPENDENCIES = f"""
kids as (select doc_id, head_id as tok_id, count(*) as n from tok where head_id <> tok_id group by doc_id, head_id),
hd as (select t.doc_id, t.sent_id, t.dep, coalesce(n, 0) as n from tok t left join kids k on t.doc_id = k.doc_id and t.tok_id = k.tok_id where dep in ('ROOT', 'conj') or {SUB}),
hs as (select doc_id, sent_id, avg(n) filter (where dep = 'ROOT') as m, avg(n) filter (where {SUB}) as s, avg(n) filter (where dep = 'conj') as c, max(n) as x from hd group by doc_id, sent_id),
ar as (select doc_id, sent_id, coalesce(sum(abs(tok_id - head_id)) filter (where tok_id <> head_id)::double / nullif(count(*) filter (where tok_id <> head_id), 0), 0) as mean_dependency_distance from tok group by doc_id, sent_id),
de as (select ar.doc_id, ar.sent_id, coalesce(m, 0) as main_clause, coalesce(s, 0) as subordinate_clause, coalesce(c, 0) as coordinate_clause, coalesce(x, 0) as max_dependents, mean_dependency_distance
  from ar left join hs on ar.doc_id = hs.doc_id and ar.sent_id = hs.sent_id)"""
CONTENT = """
ic as (select s.doc_id, s.sent_id, information_content, coalesce(ic_count, 0) as ic_count from (select distinct doc_id, sent_id from tok) s left join (
  select doc_id, sent_id, list_reduce(list_prepend(0e0, list(-ln(freq::double) order by tok_id)), lambda a, b: a + b) / count(*) as information_content, count(*) as ic_count
  from tok join freqs on lower(tok.text) = freqs.word where is_alpha group by doc_id, sent_id) i on s.doc_id = i.doc_id and s.sent_id = i.sent_id)"""
COHESION = """
lem as (select doc_id, sent_id, list(distinct lower(lemma)) filter (where is_alpha) as own from tok group by doc_id, sent_id),
co as (select doc_id, sent_id, case when sent_id > 0 then len(list_intersect(coalesce(own, []), coalesce(lag(own) over (partition by doc_id order by sent_id), []))) end as cohesion_overlap from lem)"""
AVERAGE = f"""
aw0 as (select doc_id, sent_id, sum(coalesce(freq, 1)) as total, count(*) as n, count(*) filter (where pos in ('NOUN', 'VERB', 'ADJ', 'ADV')) as content from tok left join freqs on lower(tok.text) = freqs.word where is_alpha group by doc_id, sent_id),
aw1 as (select doc_id, sent_id, total::double / n as m, (total::double / n) / (select avg(freq) from freqs) as r, case when n > content then content::double / (n - content) end as q from aw0),
aw as (select doc_id, sent_id, {R("m", 3)} as avg_word_freq, {R("r", 3)} as normalized_freq, coalesce({R("q", 3)}, 0) as content_function_ratio from aw1)"""


CLAUSE_ROLES = f"""
sub as (select x.doc_id, x.a, string_agg(w.text, ' ' order by w.tok_id) as s from tree x join tok w on x.doc_id = w.doc_id and x.tok_id = w.tok_id group by x.doc_id, x.a),
arg as (select j.doc_id, j.head_id as v, string_agg(s, '; ' order by j.tok_id) filter (where j.dep like '%subj%') as agent, string_agg(s, '; ' order by j.tok_id) filter (where j.dep like '%obj%') as patient
  from tok j join sub on sub.doc_id = j.doc_id and sub.a = j.tok_id where j.head_id <> j.tok_id group by j.doc_id, j.head_id),
ap as (select v.doc_id, v.sent_id, v.tok_id, case when v.dep = 'ROOT' then 'main' when v.dep = 'conj' then 'coordinate' else 'subordinate' end as clause_level, v.lemma as predicate, agent, patient, sub.s as clause_tokens
  from tok v join sub on sub.doc_id = v.doc_id and sub.a = v.tok_id left join arg on arg.doc_id = v.doc_id and arg.v = v.tok_id where v.pos = 'VERB' and (v.dep in ('ROOT', 'conj') or v.{SUB})),
st as (select s.doc_id, s.sent_id, any_value(s.sentence) as sentence, count(ap.tok_id) as c, count(agent) as a, count(patient) as p, coalesce(string_agg(clause_level || ':' || predicate, ',' order by ap.tok_id), '') as clauses
  from (select * from sent where (doc_id, sent_id) in (select doc_id, sent_id from tok)) s left join ap on ap.doc_id = s.doc_id and ap.sent_id = s.sent_id group by s.doc_id, s.sent_id),
sw as (select doc_id, sent_id, count(*) over w as n, max(sent_id) over w as e, sum(c) over w as c, sum(a) over w as a, sum(p) over w as p, list(sentence) over w as l from st window w as (partition by doc_id order by sent_id rows between current row and 2 following)),
tw3 as (select doc_id, sent_id::bigint as start_sentence, e::bigint as end_sentence, c::bigint as total_clauses, a::bigint as total_agents, p::bigint as total_patients, array_to_string(l, '|') as sentences from sw where n = 3)"""
SURPRISAL = f"""
wl as (select unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) as w from documents), uf as (select w, count(*) as f from wl group by w), mass as (select sum(f) + count(*) as m from uf),
lp as (select doc_id, sent_id, -ln((coalesce(f, 0) + 1) / m::double) as p from tok left join uf on lower(tok.text) = uf.w cross join mass where is_alpha),
s1 as (select doc_id, sent_id, avg(p) as m, coalesce(var_samp(p), 0) as v from lp group by doc_id, sent_id), s2 as (select doc_id, sent_id, m, v, m / (select avg(p) from lp) as q from s1),
su as (select s.doc_id, s.sent_id, coalesce({R('m', 3)}, 0) as mean_surprisal, coalesce({R('v', 3)}, 0) as surprisal_variance, coalesce({R('q', 3)}, 0) as normalized_surprisal from (select distinct doc_id, sent_id from tok) s left join s2 on s.doc_id = s2.doc_id and s.sent_id = s2.sent_id)"""


def _mean(c: str) -> str:
    return f"list_reduce(list_prepend(0e0, list({c}::double order by sent_id) filter (where {c} is not null)), lambda a, b: a + b) / nullif(count({c}), 0)"


def tumbling(source: str, means: list[str], nullable: list[str] = (), firsts: list[str] = (), size: int = 3) -> str:
    inner = [f"{_mean(c)} as m_{c}" for c in [*means, *nullable]] + [f"first({c} order by sent_id) as f_{c}" for c in [*nullable, *firsts]]
    outer = [f"{R(f'm_{c}')} as {c}" for c in means] + [f"case when f_{c} is not null then {R(f'm_{c}')} end as {c}" for c in nullable] + [f"f_{c} as {c}" for c in firsts]
    return f"""select doc_id, window_id, start_sentence, end_sentence, {', '.join(outer)} from (
      select doc_id, (sent_id // {size})::bigint as window_id, min(sent_id)::bigint as start_sentence, max(sent_id)::bigint as end_sentence, {', '.join(inner)} from {source} group by doc_id, sent_id // {size})"""


def _series(windows: str, *values: str) -> str:
    return f"select doc_id, (start_sentence + end_sentence) // 2 as midpoint, {', '.join(values)} from ({windows})"


CLAUSE = ["main", "subordinate", "coordinate", "subordination_ratio", "coordination_ratio"]
DEPTH = ["max_depth", "mean_depth", "median_depth", "depth_skew"]
DEPENDENCY = ["main_clause", "subordinate_clause", "coordinate_clause", "max_dependents", "mean_dependency_distance"]
W_CLAUSE, W_DEPTH, W_DEPENDENCY = tumbling("cl", CLAUSE), tumbling("dp", DEPTH), tumbling("de", DEPENDENCY)
KEYS = "doc_id, window_id, start_sentence, end_sentence"
CHUNKS = r"""
lists as (select doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') as t from documents),
ck as (select doc_id, (i // {step})::int as chunk_id, i::int as start_token, least(i + {size}, len(t))::int as end_token, (least(i + {size}, len(t)) - i)::int as num_tokens, list_slice(t, i + 1, i + {size}) as c
  from (select doc_id, t, unnest(range(0, len(t), {step})) as i from lists where len(t) > 0))"""
C2048, C512 = CHUNKS.format(size=2048, step=2048), CHUNKS.format(size=512, step=448)
SCORES = C2048 + """,
wf as (select w, count(*) as f from (select unnest(t) as w from lists) group by w),
mass as (select sum(f) + count(*) as m from wf),
sc as (select doc_id, chunk_id, sum(ln((f + 1) / m::double)) / count(*) as lp from (select doc_id, chunk_id, unnest(c) as w from ck) x join wf on x.w = wf.w cross join mass group by doc_id, chunk_id),
cs as (select ck.doc_id, ck.chunk_id, start_token, end_token, lp, num_tokens, array_to_string(list_slice(c, 1, 50), ' ') as text_snippet from ck join sc on ck.doc_id = sc.doc_id and ck.chunk_id = sc.chunk_id)"""
TOP = """
tw as (select doc_id, word, freq, rank from (select *, row_number() over (partition by doc_id order by freq desc, first)::int as rank from (
  select doc_id, word, count(*) as freq, min(pos) as first from words group by doc_id, word having count(*) >= 2)) where rank <= 50)"""
EDGES = """
ed as (select a.label as doc_id, a.vec_id as src, b.vec_id as dst, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as weight
  from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= {least})"""
HOPS = EDGES.format(least=0.1) + """,
arc as (select doc_id, src as a, dst as b from ed union all select doc_id, dst, src from ed),
far(doc_id, s, t, d) as (select label, vec_id, vec_id, 0 from embeddings union select f.doc_id, f.s, b.b, f.d + 1 from far f join arc b on f.doc_id = b.doc_id and f.t = b.a where f.d < 12),
hop as (select doc_id, s, t, min(d) as d from far group by all),
nn as (select label as doc_id, count(*) as n from embeddings group by label)"""
PATHS = HOPS + """,
cnt(doc_id, s, t, d, c) as (select doc_id, s, t, 0, 1::double from hop where d = 0 union all
  select doc_id, s, t, d, sum(c) from (select k.doc_id, k.s, h.t, h.d, k.c from cnt k join arc b on k.doc_id = b.doc_id and k.t = b.a join hop h on h.doc_id = k.doc_id and h.s = k.s and h.t = b.b and h.d = k.d + 1) group by doc_id, s, t, d),
btw as (select x.doc_id, x.t as node_id, sum(x.c * y.c / z.c) / 2 as b from cnt x join cnt y on x.doc_id = y.doc_id and x.t = y.s join cnt z on z.doc_id = x.doc_id and z.s = x.s and z.t = y.t and z.d = x.d + y.d where x.s <> x.t and y.s <> y.t group by all)"""
NP = r"""
np0 as (select *, pos in ('DET', 'ADJ', 'NUM', 'NOUN') as in_np from tok),
np1 as (select *, in_np and not coalesce(lag(in_np) over (partition by doc_id, sent_id order by tok_id), false) as start from np0),
np2 as (select * from (select *, max(case when start then tok_id end) over (partition by doc_id, sent_id order by tok_id) as chunk from np1) where in_np),
np3 as (select * from (select *, count(*) filter (where pos = 'NOUN') over (partition by doc_id, sent_id, chunk) as nouns from np2) where nouns > 0),
np4 as (select doc_id, chunk, tok_id, lower(lemma) as w from np3 where not is_punct and regexp_matches(lower(lemma), '[\p{{L}}\p{{N}}]')),
np5 as (select doc_id, chunk, list_filter(list(w order by tok_id), lambda x: not list_contains([{stop}], x)) as l from np4 group by doc_id, chunk),
np6 as (select doc_id, chunk, lower(array_to_string(l, ' ')) as phrase from np5 where len(l) > 1 or (len(l) = 1 and regexp_full_match(l[1], '\p{{L}}+'))),
ph as (select doc_id, (row_number() over (partition by doc_id order by at0, phrase) - 1)::int as phrase_idx, phrase, n as occurrences from (
  select doc_id, phrase, min(chunk) as at0, count(*) as n from np6 where regexp_matches(phrase, '[A-Za-z]') group by doc_id, phrase))"""


def oracle_sql() -> dict[str, str]:
    from ..operators.concepts import STOP_WORDS
    from ..operators.discourse import CONNECTIVES

    np = NP.format(stop=_listed(STOP_WORDS))
    t = f"with recursive {TOKENS}"
    patterns = [r"^\s*\d+\s*$", r"^\s*(?:chapter|part|page)\s+\S+\s*$", r"https?://\S+"]
    text = "text"
    for p in patterns:
        text = f"regexp_replace({text}, '(?im){p}', ' ', 'g')"
    ws = r"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
    start = "case when strpos(text, 'the ') > 0 then substr(text, strpos(text, 'the ')) else text end"
    series3 = lambda w, v: f"{t}, {w[0]} {_series(w[1], *v)}"
    return {
        "top_words": f"with {WORDS}, {TOP} select * from tw",
        "clean": f"select doc_id, {ws.format(x='text')} as text from documents",
        "marker_trim": f"select doc_id, {ws.format(x='case when strpos(x, ' + chr(39) + 'and' + chr(39) + ') > 0 then substr(x, 1, strpos(x, ' + chr(39) + 'and' + chr(39) + ') + 2) else x end')} as text from (select doc_id, {start} as x from documents)",
        "word_freq": f"with {WORDS} select word, freq from freqs where freq >= 2",
        "sentence_split": f"with {SENTENCES} select * from sent",
        "tokens": f"{t} select * from tok",
        "lexical_density": f"{t}, {DENSITY} select * from dens",
        "lexical_density_w3": f"{t}, {DENSITY} {tumbling('dens', ['token_count', 'content_count'], ['lexical_density'])}",
        "information_content_w3": f"with recursive {WORDS}, {TOKENS}, {CONTENT} {tumbling('ic', [], ['information_content'], ['ic_count'])}",
        "cohesion_w3": f"{t}, {COHESION} {tumbling('co', [], ['cohesion_overlap'])}",
        "clause_metrics": f"{t}, {CLAUSES} select * from cl",
        "clause_metrics_w3": f"{t}, {CLAUSES} {W_CLAUSE}",
        "depth_w3": f"{t}, {DEPTHS} {W_DEPTH}",
        "dependency_w3": f"{t}, {DEPENDENCIES} {W_DEPENDENCY}",
        "semantic_roles": f"""{t}, ro as (select t.doc_id, t.sent_id, string_agg(t.dep || ':' || t.text || ':' || h.text, ',' order by t.tok_id) as r, count(*) as n from tok t join tok h on t.doc_id = h.doc_id and t.head_id = h.tok_id where t.dep in ('nsubj', 'dobj', 'iobj', 'pobj') group by all)
          select s.doc_id, s.sent_id, s.sentence as sentence_text, coalesce(r, '') as roles, coalesce(n, 0) as role_count from sent s left join ro on s.doc_id = ro.doc_id and s.sent_id = ro.sent_id where (s.doc_id, s.sent_id) in (select doc_id, sent_id from tok)""",
        "sliding_density": f"""{t}, {DENSITY}, sl as (select doc_id, sent_id, count(*) over w as n, max(sent_id) over w as e, list(token_count::double) over w as a, list(content_count::double) over w as b, list(lexical_density) over w as c from dens
          window w as (partition by doc_id order by sent_id rows between current row and 2 following)),
          sm as (select doc_id, sent_id, e, list_reduce(list_prepend(0e0, a), lambda x, y: x + y) / len(a) as a, list_reduce(list_prepend(0e0, b), lambda x, y: x + y) / len(b) as b,
            list_reduce(list_prepend(0e0, list_filter(c, lambda x: x is not null)), lambda x, y: x + y) / nullif(len(list_filter(c, lambda x: x is not null)), 0) as c from sl where n = 3)
          select doc_id, sent_id::bigint as start_sentence, e::bigint as end_sentence, {R('a')} as token_count, {R('b')} as content_count, {R('c')} as lexical_density from sm""",
        "mattr_50": rf"""with w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: regexp_full_match(x, '\p{{L}}+')) as w from documents),
          f as (select doc_id, sum(k)::double / 50 / count(*) as m from (select doc_id, len(list_distinct(list_slice(w, s, s + 49))) as k from (select doc_id, w, unnest(range(1, len(w) - 48)) as s from w where len(w) >= 50)) group by doc_id)
          select w.doc_id, case when len(w) >= 50 then {R('m', 3)} when len(w) > 0 then len(list_distinct(w))::double / len(w) else 0 end as mattr from w left join f on w.doc_id = f.doc_id""",
        "avg_word_freq": f"with recursive {WORDS}, {TOKENS}, {AVERAGE} select * from aw",
        "chunks_2048": f"with {C2048} select doc_id, chunk_id, start_token, end_token, num_tokens from ck",
        "chunks_overlap": f"with {C512} select doc_id, chunk_id, start_token, end_token, num_tokens from ck",
        "chunk_scores": f"with {SCORES} select doc_id, chunk_id, start_token, end_token, round(lp, 6) as avg_log_prob, num_tokens, text_snippet from cs",
        "doc_logprob": f"with {SCORES} select doc_id, round(avg(lp), 6) as avg_log_prob, sum(num_tokens)::bigint as num_tokens from cs group by doc_id",
        "whole_text": f"""with {SCORES}, {WORDS}, {TOP}, d as (select doc_id, avg(lp) as a, sum(num_tokens)::bigint as n, count(*) as k from cs group by doc_id),
          j as (select doc_id, string_agg(word || ':' || freq, ',' order by rank) as s from tw group by doc_id)
          select x.doc_id, 'unigram' as model, round(a, 6) as avg_log_prob, coalesce(n, 0) as num_tokens, coalesce(s, '') as top_words, coalesce(k, 0) as chunks from documents x left join d on x.doc_id = d.doc_id left join j on x.doc_id = j.doc_id""",
        "turn_overlap": r"""with o as (select conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: regexp_full_match(x, '\p{L}+'))) as own from conversations),
          l as (select *, lag(own) over (partition by conv_id order by turn) as last from o) select conv_id, turn, case when last is not null then len(list_intersect(last, own)) end as overlap from l""",
        "clause_series": series3((f"{CLAUSES}", W_CLAUSE), ("subordinate", "coordinate")),
        "depth_series": series3((f"{DEPTHS}", W_DEPTH), DEPTH),
        "dependency_series": series3((f"{DEPENDENCIES}", W_DEPENDENCY), DEPENDENCY),
        "syntax_analysis": f"{t}, {CLAUSES}, {DEPTHS}, {DEPENDENCIES} select * from ({W_CLAUSE}) join ({W_DEPTH}) using ({KEYS}) join ({W_DEPENDENCY}) using ({KEYS})",
        "phrases": f"{t}, {np} select * from ph",
        "top_n_phrases": f"{t}, {np} select * from ph where phrase_idx < 100",
        "sim_edges": f"with {EDGES.format(least=0.3)} select doc_id, src, dst, round(weight, 6) as weight from ed",
        "degree": f"""with {EDGES.format(least=0.1)}, c as (select doc_id, v, count(*) as c from (select doc_id, src as v from ed union all select doc_id, dst from ed) group by all), n as (select label, count(*) as n from embeddings group by label)
          select e.label as doc_id, e.vec_id as node_id, round(case when n > 1 then coalesce(c, 0)::double / (n - 1) else 1 end, 6) as degree from embeddings e join n on e.label = n.label left join c on c.doc_id = e.label and c.v = e.vec_id""",
        "closeness": f"with recursive {HOPS} select h.doc_id, s as node_id, round(case when sum(d) > 0 then ((count(*) - 1)::double / sum(d)) * (count(*) - 1) / (any_value(n) - 1) else 0 end, 6) as closeness from hop h join nn on h.doc_id = nn.doc_id group by h.doc_id, s",
        "betweenness": f"with recursive {PATHS} select e.label as doc_id, e.vec_id as node_id, round(coalesce(b, 0) * 2 / ((n - 1) * (n - 2)), 6) as betweenness from embeddings e join nn on e.label = nn.doc_id left join btw on btw.doc_id = e.label and btw.node_id = e.vec_id",
        "surprisal": f"{t}, {SURPRISAL} select * from su",
        "agent_patient": f"{t}, {TREE}, {CLAUSE_ROLES} select * from ap",
        "agent_windows": f"{t}, {TREE}, {CLAUSE_ROLES} select * from tw3",
        "clause_structures": f"{t}, {TREE}, {CLAUSE_ROLES} select doc_id, sent_id, clauses, c as num_clauses, a as num_agents, p as num_patients from st",
        "information_content": f"""with recursive {WORDS}, {TOKENS}, {CONTENT}, fs as (select doc_id, sent_id, string_agg(freq::varchar, ',' order by tok_id) as f from tok join freqs on lower(tok.text) = freqs.word where is_alpha group by doc_id, sent_id)
          select ic.doc_id, ic.sent_id, round(information_content, 9) as information_content, ic_count, coalesce(f, '') as freqs from ic left join fs on ic.doc_id = fs.doc_id and ic.sent_id = fs.sent_id""",
        "lemmas": f"{t} select doc_id, string_agg(lemma, ' ' order by tok_id) as lemmas from tok group by doc_id",
        "text_tokens": f"{t} select doc_id, string_agg(text, ' ' order by tok_id) as tokens from tok group by doc_id",
        "window_metrics": f"""with recursive {WORDS}, {TOKENS}, {CLAUSES}, {DEPTHS}, {DEPENDENCIES}, {DENSITY}, {CONTENT}, {COHESION}, {AVERAGE}, {SURPRISAL}, {CLAUSE_ROLES}
          select x.*, avg_word_freq, normalized_freq, content_function_ratio, total_clauses, total_agents, total_patients from (select * from ({W_CLAUSE}) join ({W_DEPTH}) using ({KEYS}) join ({W_DEPENDENCY}) using ({KEYS}) join ({tumbling('dens', ['token_count', 'content_count'], ['lexical_density'])}) using ({KEYS})
            join ({tumbling('ic', [], ['information_content'], ['ic_count'])}) using ({KEYS}) join ({tumbling('co', [], ['cohesion_overlap'])}) using ({KEYS}) join ({tumbling('su', ['mean_surprisal', 'surprisal_variance', 'normalized_surprisal'])}) using ({KEYS})) x
          left join ({tumbling('aw', ['avg_word_freq', 'normalized_freq', 'content_function_ratio'])}) y on x.doc_id = y.doc_id and x.window_id = y.window_id left join tw3 on tw3.doc_id = x.doc_id and tw3.start_sentence = x.start_sentence""",
        "edge_style": f"""with recursive {PATHS}, bt as (select e.label as doc_id, e.vec_id as v, coalesce(b, 0) as b from embeddings e left join btw on btw.doc_id = e.label and btw.node_id = e.vec_id),
          sc as (select doc_id, v, case when max(b) over w > min(b) over w then (b - min(b) over w) / (max(b) over w - min(b) over w) else 0 end as b from bt window w as (partition by doc_id))
          select ed.doc_id, src, dst, round(0.5 + 4 * (x.b + y.b) / 2, 6) as width, round(0.3 + 0.7 * (x.b + y.b) / 2, 6) as alpha from ed join sc x on x.doc_id = ed.doc_id and x.v = src join sc y on y.doc_id = ed.doc_id and y.v = dst""",
        "discourse_baseline": f"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{TOKEN}') as t from documents),
          f as (select doc_id, t, list_min(list_filter(range(1, len(t) + 1), lambda i: lower(t[i]) in ({_listed(CONNECTIVES)}))) as k from d)
          select doc_id, 'Expansion' as level1, 'Conjunction' as level2, null::varchar as level3, case when k is null then '' else coalesce(array_to_string(t[1:k - 1], ' '), '') end as arg1_span, case when k is null then '' else coalesce(array_to_string(t[k + 1:], ' '), '') end as arg2_span,
            t[k] as connective, case when k is null then 'false' else 'true' end as explicit, 'forward' as direction from f""",
        "roman_numerals": rf"""with p as (select doc_id, list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}\p{{M}}_]+\.?|[^\p{{L}}\p{{N}}\p{{M}}_]'), lambda x: case when regexp_full_match(x, '(?i)[ivxlc]+\.?') then ' ' else x end) as l from documents)
          select doc_id, {ws.format(x="coalesce(array_to_string(l, ''), '')")} as text from p""",
        "incremental_todo": "select doc_id from documents where doc_id not in (select doc_id from labels)",
        "rounding": f"select l_orderkey, l_linenumber, {R('x')} as two, {R('x', 3)} as three from (select l_orderkey, l_linenumber, l_extendedprice * l_discount / 7 as x from lineitem)",
        "boilerplate": f"select doc_id, {ws.format(x=text)} as text from documents",
    }
