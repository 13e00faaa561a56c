"""Which columns of a layer form its hierarchy: levels, names and codes, found from the values alone."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.functions.hierarchy import Target, free_sibling
from terrace.operators.schema_detect import apply_crosswalk, candidates, code_shaped, containment, distinct_counts, embeds

# A column as good as unique tells no level; a column that collapses to few values of a level's units is supplemental.
UNIQUE_SHARE, COLLAPSE, JOINT_VALUES = 0.9, 0.30, 10


@dataclass
class Facts:
    """What one pass for each column tells: distinct values, filled rows, and which columns hold each column's values."""

    rows: int
    distinct: dict[str, int] = field(default_factory=dict)
    filled: dict[str, int] = field(default_factory=dict)
    inside: set[tuple[str, str]] = field(default_factory=set)  # (finer, coarser)
    perfect: set[tuple[str, str]] = field(default_factory=set)
    coded: set[str] = field(default_factory=set)


def facts(layer: DataFrame, columns: list[str]) -> Facts:
    """One stacked count, then one grouped pass for each column over all others: k jobs for k columns, each with a one-row result."""
    counts = {r["column"]: r for r in distinct_counts(layer, columns).collect()}
    out = Facts(next(iter(counts.values())).n_rows if counts else 0)
    for c in columns:
        out.distinct[c], out.filled[c] = counts[c].n_distinct, counts[c].n_filled
    live = [c for c in columns if out.distinct[c]]
    for finer in live:
        coarser = [c for c in live if c != finer and out.distinct[c] <= out.distinct[finer]]
        for r in containment(layer, finer, coarser).collect() if coarser else []:
            if r.holds:
                out.inside.add((finer, r.coarser))
            if r.perfect:
                out.perfect.add((finer, r.coarser))
    if live:
        out.coded = {r["column"] for r in code_shaped(layer, live).collect() if r.code_shaped}
    return out


def groups_of(known: Facts) -> list[list[str]]:
    """Columns that tell the same units apart: equally many values, each inside the other. From the fewest units to the most."""
    groups: list[list[str]] = []
    for c in sorted((c for c, n in known.distinct.items() if n), key=lambda c: known.distinct[c]):
        for g in groups:
            if known.distinct[g[0]] == known.distinct[c] and (known.distinct[c] == 1 or {(c, g[0]), (g[0], c)} <= known.inside):
                g.append(c)
                break
        else:
            groups.append([c])
    return groups


def chain(layer: DataFrame, known: Facts) -> list[list[str]]:
    """The longest run of groups in which each lies inside the one before and a code of it embeds one before, where any codes embed at all.

    Groups of constants come first, as the root. Ties go to the run with more columns, then more units.
    """
    groups = [g for g in groups_of(known) if known.distinct[g[0]] > 1]
    root = [g for g in groups_of(known) if known.distinct[g[0]] == 1]
    joins = {(i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if known.distinct[a[0]] < known.distinct[b[0]] and any((y, x) in known.inside for x in a for y in b)}
    held: dict[tuple[str, str], bool] = {}

    def embedded(i: int, j: int) -> bool:
        for x in groups[i]:
            for y in groups[j]:
                if x in known.coded and y in known.coded:
                    if (x, y) not in held:
                        held[x, y] = bool(embeds(layer, y, x).first().holds)
                    if held[x, y]:
                        return True
        return False

    links = {e for e in joins if embedded(*e)} or {(i, j) for i, j in joins if known.distinct[groups[j][0]] / max(1, known.rows) < UNIQUE_SHARE or any((y, x) in known.perfect for x in groups[i] for y in groups[j])}
    best: dict[int, tuple[tuple[int, int, int], list[int]]] = {}
    for j in range(len(groups)):
        size = len(groups[j])
        best[j] = ((1, size, known.distinct[groups[j][0]]), [j])
        for i in range(j):
            if (i, j) in links:
                score = (best[i][0][0] + 1, best[i][0][1] + size, known.distinct[groups[j][0]])
                if score > best[j][0]:
                    best[j] = (score, best[i][1] + [j])
    run = max(best.values(), key=lambda x: x[0])[1] if best else []
    return ([[c for g in root for c in g]] if root else []) + [groups[i] for i in run]


def schema_map(layer: DataFrame, fields: Target = Target(), level: int | None = None) -> DataFrame:
    """The crosswalk (column_order, source_column, target_column, unique_count, note): each level's names and codes under the templates.

    The first level is 0 if constants make a root, else 1; `level` anchors the deepest. In a level, columns whose values mostly hold a digit are codes, others names; where all do, column names tell.
    Further ones get numbered siblings. Columns off the chain are matched to the level that they lie in: supplemental, without a target.
    """
    columns = candidates(layer)
    known = facts(layer, columns)
    found = chain(layer, known)
    first = 0 if found and known.distinct[found[0][0]] == 1 else 1
    if level is not None:
        first = level - len(found) + 1
    targets: dict[str, str] = {}
    at: dict[str, int] = {}
    mark = fields.name_field.split("{n}")[1].strip("_").lower()
    for n, group in enumerate(found, first):
        coded = {c for c in group if c in known.coded}
        if len(coded) > 1 and coded == set(group):  # all look like codes: the names of the columns tell
            coded = {c for c in group if not mark or mark not in c.lower()} or coded
        for codes in (False, True):
            for c in (c for c in group if (c in coded) == codes):
                name = fields.code(n) if codes else fields.name(n)
                targets[c] = name if name not in targets.values() else free_sibling(name, targets.values())
                at[c] = n
    rows = []
    for c in columns:
        note = None
        if c not in targets:
            home = next((n for n, g in reversed(list(enumerate(found, first))) if any((x, c) in known.inside for x in g)), None)
            note = "empty" if not known.distinct[c] else "not part of the hierarchy" if home is None else f"supplemental to level {home}"
        rows.append((c, targets.get(c), known.distinct[c], note))
    rows.sort(key=lambda r: (r[1] is None, -at.get(r[0], 0), r[0] in known.coded, columns.index(r[0])))
    numbered = [(i + 1, *r) for i, r in enumerate(rows)]
    return layer.sparkSession.createDataFrame(numbered, "column_order int, source_column string, target_column string, unique_count long, note string")


def mapped(layer: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """layer under the crosswalk's target names; columns without a target keep theirs."""
    names = {r.source_column: r.target_column for r in crosswalk.collect()}  # a row for each column
    own = [c for c in layer.columns if c not in ("fid", "geom")]
    return apply_crosswalk(layer, [(c, names.get(c) or c) for c in own])


def spatial_anchor(layer: DataFrame, columns: list[str]) -> DataFrame:
    """(column, coherent) for layers with places: whether a column's groups lie together."""
    from terrace.operators.schema_detect import coherence

    out = None
    for c in columns:
        row = coherence(layer, c, "x", "y").select(F.lit(c).alias("column"), "coherent")
        out = row if out is None else out.unionByName(row)
    return out
