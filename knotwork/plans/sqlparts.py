"""Common table expressions of the checking SQL: the views of ``operators.kg`` in another engine's terms."""

from __future__ import annotations


def cid(column: str) -> str:
    return f"nullif(upper(trim({column}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), '')"


def norm(column: str) -> str:
    return rf"trim(regexp_replace(lower({column}), '\s+', ' ', 'g'))"


DELIVERIES = f"dlv AS (SELECT {cid('entity_id')} AS id, rec_id, trim(coalesce(entity_name, '')) AS name, coalesce(entity_aliases, '') AS aliases, trim(coalesce(entity_description, '')) AS descr FROM entities WHERE {cid('entity_id')} IS NOT NULL)"
ENT = f"{DELIVERIES}, ent AS (SELECT id, name, aliases, descr FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rec_id) AS rn FROM dlv) WHERE rn = 1)"
REL = f"rl AS (SELECT {cid('relation_id')} AS rel, lower(trim(coalesce(relation_name, ''))) AS rel_name FROM relations)"
TRI = f"tri AS (SELECT triple_id, {cid('entity_1_id')} AS src, {cid('relation_id')} AS rel, {cid('entity_2_id')} AS dst FROM triples)"
SOUND = f"{ENT}, {REL}, {TRI}, snd AS (SELECT * FROM tri WHERE src IN (SELECT id FROM ent) AND dst IN (SELECT id FROM ent) AND rel IN (SELECT rel FROM rl))"
EDGES = f"{SOUND}, edg AS (SELECT DISTINCT src, rel, dst FROM snd)"
MEM = f"mem AS (SELECT {cid('entity_id')} AS id, min(partition_id) AS pid FROM entity_map WHERE partition_id IS NOT NULL AND {cid('entity_id')} IS NOT NULL GROUP BY 1)"
ALIASES = "list_filter(list_transform(string_split(aliases, '|'), lambda a: trim(a)), lambda a: a <> '')"
