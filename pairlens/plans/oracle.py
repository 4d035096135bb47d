"""Independent SQL formulations (DuckDB dialect) of every registered query.

The oracle is written the naive way on purpose - full candidate joins, global
``row_number`` windows, explicit arithmetic over the five probabilities - so it checks
the engine's scale-oriented plans (tiled top-k, positional sampling, pre-aggregation)
rather than repeating them. Shared derived tables are CTEs; unused ones are ignored.
"""
from __future__ import annotations

from pairlens.constants import CONCEPTS, DEFAULT_SEED, DIRECTIONS

SEED = DEFAULT_SEED
N_EMB = "(select count(*) from embeddings)"
DIRS = ", ".join(f"'{d}'" for d in DIRECTIONS)
CONS = ", ".join(f"'{c}'" for c in CONCEPTS)


def _wheel(expr: str, values) -> str:
    whens = " ".join(f"when {i} then '{v}'" for i, v in enumerate(values[:-1]))
    return f"(case {expr} {whens} else '{values[-1]}' end)"


def _aspect(ci: int, c: str) -> str:
    four = [*DIRECTIONS, ""]
    return (f"case when pos = 0 or edit_type <> '{c}' then {_wheel(f'(oid + {ci}) % 4', four)} "
            f"else {_wheel(f'(oid + {ci} + pos) % 3', list(DIRECTIONS))} end as {c}_aspect_majority")


def _md5_int(expr: str) -> str:
    return f"('0x' || substr(md5('{SEED}|' || cast({expr} as varchar)), 1, 15))::bigint"


def _md5(expr: str) -> str:
    return f"md5('{SEED}|' || cast({expr} as varchar))"


def l2(a: str, b: str, n: int = 5) -> str:
    return "sqrt(" + " + ".join(f"({a}{i} - {b}{i}) * ({a}{i} - {b}{i})" for i in range(1, n + 1)) + ")"


_REVIEWS = f"""
fx_reviews as (
  select id, original_id, is_original, edit_type, description, review_majority,
         {", ".join(f"{c}_aspect_majority" for c in CONCEPTS)}, split
  from (
    select *, {", ".join(_aspect(ci, c) for ci, c in enumerate(CONCEPTS))},
      case when id % 11 = 10 then 'no majority' else cast(1 + id % 5 as varchar) end as review_majority,
      case oid % 5 when 0 then 'validation' when 1 then 'test' else 'train_exclusive' end as split
    from (
      select *, case when pos = 0 then null else
          {_wheel('(oid + (case when pos <= 2 then 0 else 1 end)) % 4', list(CONCEPTS))} end as edit_type
      from (select doc_id as id, cast(floor(doc_id / 5) as bigint) as oid, cast(floor(doc_id / 5) as bigint) as original_id,
                   doc_id % 5 as pos, doc_id % 5 = 0 as is_original, text as description from documents) a) b) c)"""

_GEN_PRED = ",\n  ".join(
    f"case when ci = {cj} then (case when g_id % 7 = 0 then base_direction else target_direction end) "
    f"when g_id % 7 = 1 and ci = {(cj + 3) % 4} then 'unknown' else l{cj} end as {c}_predictions_generation"
    for cj, c in enumerate(CONCEPTS))

_GENERATIONS = f"""
fx_generations as (
  select g_id, original_id, split, text, failed, intervention_aspect, base_direction, target_direction,
    cast(generation_index as integer) as generation_index,
    case when g_id % 17 = 0 then null when g_id % 19 = 0 then '' when g_id % 13 = 0 then text
         when g_id % 11 = 0 then concat(other, ' reviewer') when g_id % 29 = 0 then concat(other, ' but')
         else concat(other, '.') end as generation,
  {_GEN_PRED}
  from (
    select r.id * 12 + c.ci * 3 + t.ti as g_id, c.ci, t.ti as generation_index, r.original_id, r.split, r.description as text,
           o.description as other, (r.id * 12) % 23 = 0 as failed, c.concept as intervention_aspect,
           t.target as target_direction,
           case c.ci when 0 then food_m when 1 then ambiance_m when 2 then service_m else noise_m end as base_direction,
           coalesce(nullif(food_m, ''), 'unknown') as l0, coalesce(nullif(ambiance_m, ''), 'unknown') as l1,
           coalesce(nullif(service_m, ''), 'unknown') as l2, coalesce(nullif(noise_m, ''), 'unknown') as l3
    from (select id, original_id, split, description, food_aspect_majority as food_m, ambiance_aspect_majority as ambiance_m,
                 service_aspect_majority as service_m, noise_aspect_majority as noise_m from fx_reviews where is_original) r
    cross join (values (0, 'food'), (1, 'ambiance'), (2, 'service'), (3, 'noise')) c(ci, concept)
    cross join (values (0, 'Negative'), (1, 'unknown'), (2, 'Positive')) t(ti, target)
    join (select id, description from fx_reviews) o on o.id = cast(floor((r.original_id + c.ci * 7 + t.ti * 3) / 2) as bigint)) g
  where base_direction <> target_direction)"""

F3_SQL = ("not (lower(generation) like '%review%' or lower(generation) like '%instructor%' "
          "or lower(generation) like '%no information%' or lower(generation) like '%mention%' "
          "or lower(generation) like '%there is no%' or lower(generation) like '%change%')")
F4_SQL = ("not (lower(generation) like '%the' or lower(generation) like '%a' or lower(generation) like '%,' "
          "or lower(generation) like '%however' or lower(generation) like '%unfortunately' "
          "or lower(generation) like '%but')")
F12_SQL = "not failed and generation is not null and generation <> '' and not coalesce(generation = text, false)"

_CLEAN = f"""
fx_clean as (
  select * exclude (rn) from (
    select *, row_number() over (partition by generation, base_direction, target_direction order by g_id) as rn
    from fx_generations where {F12_SQL}) d
  where rn = 1 and {F3_SQL} and {F4_SQL})"""

TREAT_CASE = "case intervention_aspect " + " ".join(
    f"when '{c}' then {c}_predictions_generation" for c in CONCEPTS) + " end"

_ACCEPTED = f"""
fx_accepted as (select * from fx_clean where target_direction = {TREAT_CASE})"""

_FULL = f"""
fx_full_set as (
  select 2 * k + src as rid, * from (
    select 0 as src, id as k, split, original_id, description as text, -1 as generation_index,
      cast(null as varchar) as intervention_aspect,
      {", ".join(f"coalesce(nullif({c}_aspect_majority, ''), 'unknown') as {c}_predictions" for c in CONCEPTS)}
    from fx_reviews
    union all
    select 1, g_id, split, original_id, generation, generation_index, intervention_aspect,
      {", ".join(f"{c}_predictions_generation" for c in CONCEPTS)}
    from fx_clean) u)"""

_EMB = f"""
emb as (
  select vec_id, u, x1 / (x1 + x2 + x3 + x4 + x5) as p1, x2 / (x1 + x2 + x3 + x4 + x5) as p2,
         x3 / (x1 + x2 + x3 + x4 + x5) as p3, x4 / (x1 + x2 + x3 + x4 + x5) as p4, x5 / (x1 + x2 + x3 + x4 + x5) as p5
  from (
    select vec_id, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12)) as u,
           exp(4 * v[1]) as x1, exp(4 * v[2]) as x2, exp(4 * v[3]) as x3, exp(4 * v[4]) as x4, exp(4 * v[5]) as x5
    from (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings) e0) e1)"""

_PAIRS_SIDE = ", ".join(
    [f"{s}.{c}_aspect_majority as {c}_{t}" for s, t in (("b", "b"), ("k", "k")) for c in CONCEPTS])
_PAIRS = f"""
pairs_raw as (
  select b.split, 'edit_original' as kind, b.id as id_base, k.id as id_counterfactual, b.original_id as original_id_base,
         b.edit_type as et_b, k.edit_type as et_k, b.review_majority as rm_b, k.review_majority as rm_k, {_PAIRS_SIDE}
  from fx_reviews b join fx_reviews k on b.original_id = k.original_id and not b.is_original and k.is_original
  union all
  select b.split, 'original_edit', b.id, k.id, b.original_id, b.edit_type, k.edit_type, b.review_majority, k.review_majority,
         {_PAIRS_SIDE}
  from fx_reviews b join fx_reviews k on b.original_id = k.original_id and b.is_original and not k.is_original
  union all
  select b.split, 'edit_edit', b.id, k.id, b.original_id, b.edit_type, k.edit_type, b.review_majority, k.review_majority,
         {_PAIRS_SIDE}
  from fx_reviews b join fx_reviews k on b.original_id = k.original_id and not b.is_original and not k.is_original
       and b.edit_type = k.edit_type and b.id <> k.id),
pairs as (
  select * from (
    select *, case it {" ".join(f"when '{c}' then {c}_b" for c in CONCEPTS)} end as iab,
              case it {" ".join(f"when '{c}' then {c}_k" for c in CONCEPTS)} end as iac
    from (select *, coalesce(et_b, et_k) as it from pairs_raw) p0) p1
  where not coalesce(iab = iac, false)),
cells as (
  select p.split, cast(id_base as varchar) || ':' || cast(id_counterfactual as varchar) as pair_id, id_base,
         id_counterfactual, original_id_base, it as concept, iab as base_direction, iac as target_direction,
         {", ".join(f"coalesce(nullif({c}_b, ''), 'unknown') as {c}_pb" for c in CONCEPTS)},
         cf.p1 as c1, cf.p2 as c2, cf.p3 as c3, cf.p4 as c4, cf.p5 as c5
  from pairs p join emb cf on cf.vec_id = p.id_counterfactual % {N_EMB}
  where p.split in ('validation', 'test') and it in ({CONS}) and iab in ({DIRS}) and iac in ({DIRS}))"""

_MATCHING = f"""
fx_halves as (
  select id, case when row_number() over (order by {_md5('id')}, id) <= floor(count(*) over () / 2) then 'train' else 'matching' end as half
  from fx_reviews where split = 'train_exclusive'),
matching as (
  select id, description as text, {", ".join(f"{c}_aspect_majority as {c}_label" for c in CONCEPTS)},
         {", ".join(f"coalesce(nullif({c}_aspect_majority, ''), 'unknown') as {c}_pred" for c in CONCEPTS)}
  from fx_reviews join fx_halves using (id) where half = 'matching'),
cand as (
  {" union all ".join(
      f"select id as cid, '{c}' as concept, {c}_label as label, "
      + ", ".join(f"{o}_pred as o{i + 1}" for i, o in enumerate([x for x in CONCEPTS if x != c]))
      + " from matching where text is not null"
      for c in CONCEPTS)})"""

_EXPANDED = f"""
fx_expanded as (
  select 2 * k + src as rid, * from (
    select 0 as src, m.id as k, r.original_id, -1 as generation_index, m.text is not null as has_text,
      {", ".join(f"m.{c}_label, m.{c}_pred as {c}_predictions" for c in CONCEPTS)}
    from matching m join fx_reviews r on r.id = m.id
    union all
    select 1, g.g_id, g.original_id, g.generation_index, g.generation is not null,
      {", ".join(f"g.{c}_predictions_generation, g.{c}_predictions_generation" for c in CONCEPTS)}
    from fx_accepted g join fx_reviews r on r.original_id = g.original_id and r.is_original join matching m on m.id = r.id) x),
xcand as (
  {" union all ".join(
      f"select rid as cid, k, '{c}' as concept, {c}_label as label, "
      + ", ".join(f"{o}_predictions as o{i + 1}" for i, o in enumerate([x for x in CONCEPTS if x != c]))
      + " from fx_expanded where has_text" for c in CONCEPTS)})"""

PRELUDE = ",".join([_REVIEWS, _GENERATIONS, _CLEAN, _ACCEPTED, _FULL, _EMB, _PAIRS, _MATCHING, _EXPANDED])


def with_prelude(body: str, extra_ctes: str = "") -> str:
    ctes = PRELUDE + ("," + extra_ctes if extra_ctes else "")
    return f"with {ctes}\n{body}"


def ranked_matches(k: int) -> str:
    """CTE ``ranked``: full label-blocked similarity join, then row_number <= k."""
    return f"""
qb as (select distinct id_base as qid, concept, target_direction as label from cells),
sims as (
  select q.qid, q.concept, q.label, c.cid, list_dot_product(eq.u, ec.u) as sim
  from qb q join cand c on c.concept = q.concept and c.label = q.label
  join emb eq on eq.vec_id = q.qid % {N_EMB} join emb ec on ec.vec_id = c.cid % {N_EMB}),
ranked as (
  select * from (select *, row_number() over (partition by concept, label, qid order by round(sim, 9) desc, cid) as rank
                 from sims) r where rank <= {k})"""
