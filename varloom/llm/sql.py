"""SQL of the queries that SQL can express, for an engine with lists and recursion."""

from __future__ import annotations

from varloom.llm import licences

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = rf"""
with recursive w as (select doc_id, regexp_extract_all(coalesce({LOWER}, ''), '[^\x20\x09-\x0D]+') w from documents),
 s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
   else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) s from w),
 x as (select doc_id, unnest(s) v from s),
 f as (select v from x group by v having count(*) > 1),
 y as (select x.doc_id, hash(v) h, v from x semi join f using (v)),
 c as (select a.doc_id a, b.doc_id b, count(*) n from y a join y b on a.v = b.v and a.doc_id < b.doc_id group by 1, 2),
 e as (select a, b from c join s p on p.doc_id = a join s q on q.doc_id = b where 100 * n >= 75 * (len(p.s) + len(q.s) - n)),
 g as (select a, b from e union all select b, a from e),
 r as (select doc_id a, doc_id b from s union select r.a, g.b from r join g on g.a = r.b),
 m as (select a doc_id, min(b) component_id from r group by a)
select doc_id, cast(len(s) as bigint) n_shingles, component_id, doc_id = component_id kept from s join m using (doc_id)
"""


def op5() -> str:
    import math
    import re
    from collections import Counter

    bags = {k: Counter(re.findall(licences._WORDS, v.lower())) for k, v in licences.TEMPLATES.items()}
    df = Counter(w for b in bags.values() for w in b)
    idf = {w: math.log((1 + len(bags)) / (1 + n)) + 1 for w, n in df.items()}
    rows = []
    for k, b in bags.items():
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in b.items()))
        rows += [f"('{k}','{w}',{n * idf[w] / norm!r}::double,{idf[w]!r}::double)" for w, n in b.items()]
    unknown = math.log(1 + len(bags)) + 1
    return rf"""
with t(licence, word, weight, idf) as (values {','.join(rows)}),
 files as (select doc_id, source||'/'||lang||'/'||doc_id||'.txt' path, source||'/'||lang dir, text from documents),
 p as (select doc_id, string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '[\r\n]+') p from files where regexp_matches(text, '{licences.SPEAKS}')),
 q as (select doc_id, len(list_filter(p, lambda s: s <> '')) n_sentences, list_filter(p, lambda s: regexp_matches(s, '{licences.SPEAKS}')) p from p),
 s as (select doc_id, n_sentences, len(p) n_speaking, unnest(p) sentence, generate_subscripts(p, 1) at_ from q),
 w as (select doc_id, at_, unnest(regexp_extract_all(lower(sentence), '{licences._WORDS}')) word from s),
 b as (select doc_id, at_, word, count(*) n from w group by all),
 i as (select distinct word, idf from t),
 g as (select b.*, n * coalesce(idf, {unknown!r}::double) w from b left join i using (word)),
 nrm as (select doc_id, at_, sqrt(sum(w * w)) norm from g group by all),
 dot as (select doc_id, at_, licence, sum(w * weight) d from g join t using (word) group by all),
 cosine as (select doc_id, licence, round(d / norm, 9) c from dot join nrm using (doc_id, at_)),
 best as (select doc_id, licence own_licence, c cosine from (select *, row_number() over (partition by doc_id order by c desc, licence) k from cosine) where k = 1 and c >= {licences.THRESHOLD}),
 own as (select f.doc_id, f.path, f.dir, own_licence, cosine, n_sentences, n_speaking from files f left join best using (doc_id) left join (select doc_id, n_sentences, len(p) n_speaking from q) using (doc_id)),
 given as (select dir, own_licence given from (select *, row_number() over (partition by dir order by cosine desc, path) k from own where own_licence is not null and n_speaking * 2 >= n_sentences) where k = 1)
select doc_id, path, own_licence, cosine, coalesce(own_licence, given) licence, case when own_licence is null and given is not null then dir end inherited_from from own left join given using (dir)
"""


FINITE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"


def op11(rounds: int = 6, parts: int = 8, entries: int = 16, scale: int = 4096, width: int = 8) -> str:
    apart = "+".join(f"(p.x[{i}]-c.x[{i}])*(p.x[{i}]-c.x[{i}])" for i in range(1, width + 1))
    mean = ",".join(f"cast(floor(sum(p.x[{i}])::double/count(*)) as bigint)" for i in range(1, width + 1))
    steps = ["c0 as materialized (select part, e, x from p join k using (vec_id))"]
    for r in range(rounds + 1):
        steps.append(f"a{r} as materialized (select p.vec_id, p.part, min(({apart})*{entries}+c.e) best from p join c{r} c using (part) group by all)")
        if r < rounds:
            steps.append(f"m{r} as (select p.part, cast(best%{entries} as bigint) e, [{mean}] x from p join a{r} using (vec_id, part) group by all)")
            steps.append(f"c{r + 1} as materialized (select c.part, c.e, coalesce(m.x, c.x) x from c{r} c left join m{r} m on m.part=c.part and m.e=c.e)")
    return f"""
with v as materialized (select vec_id, label, list_transform(embedding, lambda x: cast(floor(x*{scale}) as bigint)) x from embeddings where {FINITE}),
 p as materialized (select vec_id, t.part, x[t.part*{width}+1:t.part*{width}+{width}] x from v, range({parts}) t(part)),
 k as (select vec_id, row_number() over (order by vec_id)-1 e from v qualify e < {entries}),
 {", ".join(steps)},
 s as (select sha256(string_agg(array_to_string(x, ','), ',' order by part, e)) s from c{rounds}),
 o as (select vec_id, string_agg(printf('%02x', cast(best%{entries} as int)), '' order by part) code, cast(sum(best//{entries}) as bigint) error from a{rounds} group by vec_id)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) label_error, s codebooks_sha256 from o join v using (vec_id) cross join s
"""


OP12 = f"""
with r as materialized (select vec_id, case when vec_id%7=0 then (label+1)%10 else label end label, list_transform(embedding, lambda x: floor(x::double*256)) x from embeddings where label is not null and {FINITE}),
 s as materialized (select a.vec_id anchor_id, b.vec_id, a.label=b.label same, cast(list_dot_product(a.x, b.x) as bigint) score from r a join r b on a.vec_id%100=0 and a.vec_id<>b.vec_id),
 p as (select anchor_id, vec_id positive_id, score positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id)<=5),
 n as (select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) n, vec_id negative_id, positive_score, score negative_score from p join s using (anchor_id) where not same and 30*positive_score<=100*score and 100*score<=90*positive_score)
select anchor_id, positive_id, cast(n as int) as rank, negative_id, positive_score, negative_score from n where n<=10
"""


OP13 = f"""
with recursive v as materialized (select vec_id, label, embedding::double[] v from embeddings where label is not null and {FINITE} and len(list_filter(embedding, lambda x: x <> 0)) > 0),
 e as materialized (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.98),
 n as (select a, count(*) n from e group by a),
 r as (select vec_id a, vec_id b from embeddings union select r.a, e.b from r join e on e.a = r.b),
 m as (select a, min(b) c from r group by a)
select vec_id, coalesce(n, 0) n_links, c component_id, vec_id = c kept from embeddings join m on m.a = vec_id left join n on n.a = vec_id
"""


ORACLE_SQL = {"op4_minhash": OP4, "op5_licences": op5(), "op11_vector_codes": op11(), "op12_hard_negatives": OP12, "op13_vector_near": OP13}
