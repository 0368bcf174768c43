"""The experiment grids as one table of families: configs, parsed ids and SQL all follow from it.

A family is an id template, its axes and the config columns it sets.  An axis is a list of points, a point names the fields it
brings, so one axis can bring several (a space brings its dataset, model and components).  Configs are the product of the axes.
"""

from __future__ import annotations

import itertools
import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def axis(name: str, values) -> list[dict]:
    return [{name: v} for v in values]


@dataclass(frozen=True)
class Family:
    """``columns`` maps a config column to a constant or, as ("of", field), to a field of an axis."""

    name: str
    template: str
    axes: tuple
    columns: dict

    def points(self):
        for parts in itertools.product(*self.axes):
            yield {k: v for part in parts for k, v in part.items()}

    def configs(self) -> list[dict]:
        value = lambda v, point: point[v[1]] if isinstance(v, tuple) else v
        return [{"experiment_id": self.template.format(**p), "experiment_family": self.name} | {c: value(v, p) for c, v in self.columns.items()} for p in self.points()]

    def fields(self) -> list[str]:
        return re.findall(r"\{(\w+)[^}]*\}", self.template)

    def allowed(self, field: str) -> list[str]:
        """What stands in an id at a field's place, for any point of its axis."""
        spec = re.search(r"\{%s(:[^}]*)?\}" % field, self.template)[1] or ""
        shown = (("{0%s}" % spec).format(p[field]) for points in self.axes for p in points if field in p)
        return list(dict.fromkeys(shown))

    def pattern(self, whole: bool = True) -> str:
        """A regular expression of the family's ids, a group a field."""
        out, rest = "", self.template
        for field in self.fields():
            before, rest = re.split(r"\{%s(?::[^}]*)?\}" % field, rest, maxsplit=1)
            out += re.escape(before) + "(" + "|".join(map(re.escape, sorted(self.allowed(field), key=len, reverse=True))) + ")"
        return f"^{out}{re.escape(rest)}$" if whole else out


# Parameters and axes of the grids.
METRIC_PARAMS = '{"nhood_sizes":[1,3,10],"ntd_repeats":5,"rtd_batch":500,"rtd_trials":2,"rtd_mode":"random-coupling-exploratory"}'
PLANE = {"representation": "raw_2d", "metric_params": METRIC_PARAMS, "seed": ("of", "k")}
SPACES = [
    {"space": "pixels_pca16", "dataset": "mnist", "kind": "pixels", "pca": 16, "model": ""},
    {"space": "clip_raw", "dataset": "mnist", "kind": "clip", "pca": None, "model": "clip-vit-b32"},
    {"space": "clip_pca16", "dataset": "mnist", "kind": "clip", "pca": 16, "model": "clip-vit-b32"},
    {"space": "dino_pca16", "dataset": "mnist", "kind": "dino", "pca": 16, "model": "dinov2-vits14"},
    {"space": "vae_latent16", "dataset": "mnist", "kind": "vae", "pca": None, "model": "conv-vae-16"},
    {"space": "cifar_pixels_pca16", "dataset": "cifar10", "kind": "pixels", "pca": 16, "model": ""},
]
S1_LEVELS = {
    "shift": (0.0, 0.3, 0.6, 1.2, 1.8, 2.4, 3.0), "rotation": (0.0, 15.0, 30.0, 60.0, 120.0, 180.0, 270.0), "reflection": (0, 1),
    "scale": (0.6, 0.8, 0.9, 1.0, 1.1, 1.25, 1.5), "thickness": (0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 1.75), "anisotropy": (1.0, 1.1, 1.25, 1.5, 2.0, 2.75, 4.0),
}
DROP_INVENT = (0.0, 0.25, 0.5, 0.75)
S4_LEVELS = (0.0, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 0.75)
SCAN_ANGLES, FEW_ANGLES = (180, 270, 315, 330, 345, 350, 360), (180, 330, 360)


def sized(n, **more) -> dict:
    return {"n_P": n, "n_Q": n} | more


def of_space(kind: str) -> dict:
    return {"dataset": ("of", "dataset"), "model": ("of", "model"), "representation": ("of", kind), "pca_dim": ("of", "pca"), "seed": ("of", "k")}


def _spaces(keep) -> list[dict]:
    return [s for s in SPACES if keep(s)]


_mnist = _spaces(lambda s: s["dataset"] == "mnist")
_loops = _spaces(lambda s: s["space"] in ("pixels_pca16", "clip_pca16", "dino_pca16", "vae_latent16"))
_tenths = [{"level": n, "fraction": n / 10} for n in (1, 2, 3, 4, 5)]
_angles = [s | {"angle": a, "degrees": float(a)} for s in _loops for a in (SCAN_ANGLES if s["space"] in ("pixels_pca16", "vae_latent16") else FEW_ANGLES)]

S0 = Family("synthetic", "s0_{law}_{mode}_n{n}_k{k}", (axis("law", ("gaussian", "ring", "mixture")), axis("n", (250, 500, 1000)), axis("mode", ("copy", "samelaw")), axis("k", range(5))), PLANE | sized(("of", "n"), dataset=("of", "law")))
S1 = Family("synthetic", "s1_{transformation}_l{level}_k{k}", ([{"transformation": t, "level": str(v)} for t, vs in S1_LEVELS.items() for v in vs], axis("k", range(5))), PLANE | sized(1000, dataset="ring"))
S1_SAME = Family("synthetic", "s1samelaw_{transformation}_k{k}", (axis("transformation", S1_LEVELS), axis("k", range(5))), PLANE | sized(1000, dataset="ring"))
S3 = Family("synthetic", "s3_d{d}_i{i}_k{k}", (axis("d", DROP_INVENT), axis("i", DROP_INVENT), axis("k", range(10))), PLANE | sized(1000, dataset="modes8", drop_fraction=("of", "d"), invent_fraction=("of", "i")))
S4 = Family(
    "synthetic", "s4_{cut}_l{level}_k{k}",
    ([{"cut": c, "level": v, "d": v if c == "drop" else 0.0, "i": v if c == "invent" else 0.0} for c in ("drop", "invent") for v in S4_LEVELS], axis("k", range(10))),
    PLANE | sized(1000, dataset="modes8", drop_fraction=("of", "d"), invent_fraction=("of", "i")),
)
C0 = Family("c0_samelaw", "c0/{space}/r{k}", (SPACES, axis("k", range(5))), of_space("kind") | sized(1000))
C1A = Family("c1_drop", "c1a/{space}/d{level}/r{k}", (_mnist, _tenths, axis("k", range(5))), of_space("kind") | sized(1000, drop_fraction=("of", "fraction")))
C1B = Family("c1_invent", "c1b/{space}/a{level}/r{k}", (_mnist, _tenths, axis("k", range(5))), of_space("kind") | sized(1000, invent_fraction=("of", "fraction")))
C2R = Family("c2_resample", "c2r/{space}/{comparison}/r{k}", (_loops, axis("comparison", ("cc", "arc", "zoom")), axis("k", range(8))), of_space("space") | sized(450))
C2S = Family("c2_scan", "c2s/{space}/a{angle}/r{k}", (_angles, axis("k", range(3))), of_space("space") | sized(450, severity=("of", "degrees")))
GRIDS = {"s0": [S0], "s1": [S1], "s1samelaw": [S1_SAME], "s3": [S3], "s4": [S4], "c0": [C0], "c1": [C1A, C1B], "c2r": [C2R], "c2s": [C2S]}


def mixtures(layers, alphas, repeats: int, n_cloud: int = 500) -> list[Family]:
    """Direct, length-matched and shuffled comparisons by layer and repeat, and independent and paired mixtures by alpha."""
    # fixed values of the published families
    fixed = {"dataset": "halueval_qa", "model": "qwen2.5-3b-instruct", "representation": "hidden", "pooling": "mean_answer", "split_id": "dev"}
    base = sized(n_cloud, layer=("of", "layer"), seed=("of", "k"), **fixed)
    by_layer = (axis("layer", layers), axis("k", range(repeats)))
    by_alpha = (axis("layer", layers), axis("alpha", alphas), axis("k", range(repeats)))
    plain = {"l3/{layer}/direct/r{k}": "l3_direct", "l3d/{layer}/r{k}": "l3d_length_matched", "l3e/{layer}/r{k}": "l3e_shuffled_label"}
    out = [Family(name, template, by_layer, base) for template, name in plain.items()]
    return out + [Family(name, code + "/{layer}/a{alpha:g}/r{k}", by_alpha, base | {"alpha": ("of", "alpha")}) for code, name in (("l4a", "l4a_independent"), ("l4b", "l4b_paired"))]


def parsed(df: DataFrame, families: list[Family], column: str = "experiment_id") -> DataFrame:
    """``df`` with family and one text column for each field of the families, null where an id has none; any other id is an error."""
    c = F.col(column)
    fields = list(dict.fromkeys(f for family in families for f in family.fields()))
    name: Column = F.raise_error(F.concat(F.lit("unknown experiment id: "), F.coalesce(c, F.lit("null")))).cast("string")
    values: dict[str, Column] = {f: F.lit(None).cast("string") for f in fields}
    for family in families:
        pattern = family.pattern()
        name = F.when(c.rlike(pattern), family.name).otherwise(name)
        for place, field in enumerate(family.fields(), 1):
            values[field] = F.when(c.rlike(pattern), F.regexp_extract(c, pattern, place)).otherwise(values[field])
    return df.withColumns({"family": name} | values)


def sql(families: list[Family], all_columns: list[str], defaults: dict) -> str:
    """The ids, families and keys of the families' configs as SQL over literal axes: a twin that knows nothing of the builder."""
    text = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)
    shown = lambda field: f"CASE WHEN {field} IS NULL THEN 'null' WHEN typeof({field}) = 'VARCHAR' THEN '\"' || CAST({field} AS VARCHAR) || '\"' ELSE CAST({field} AS VARCHAR) END"
    parts = []
    for n, family in enumerate(families):
        tables = []
        for k, points in enumerate(family.axes):
            names = list(points[0])
            tables.append(f"(VALUES {', '.join('(' + ', '.join(text(p[f]) for f in names) + ')' for p in points)}) t{n}_{k}({', '.join(names)})")
        split = re.split(r"(\{\w+[^}]*\})", family.template)
        # {x:g} shows whole numbers without a point
        field = lambda x: f"regexp_replace(CAST({x[1:-3]} AS VARCHAR), '[.]0$', '')" if x.endswith(":g}") else f"CAST({x[1:-1]} AS VARCHAR)"
        ident = " || ".join(text(x) if i % 2 == 0 else field(x) for i, x in enumerate(split) if x)
        cells = []
        for column in sorted(all_columns):
            v = {"experiment_id": ("sql", ident), "experiment_family": family.name}.get(column, family.columns.get(column))
            v = defaults.get(column) if v is None else v
            value = f"'\"' || {v[1]} || '\"'" if isinstance(v, tuple) and v[0] == "sql" else shown(v[1]) if isinstance(v, tuple) else text(json.dumps(v))
            cells.append(f"'\"{column}\":' || {value}")
        whole = " || ',' || ".join(cells)
        parts.append(f"SELECT {ident} AS experiment_id, {text(family.name)} AS experiment_family, substr(sha256('{{' || {whole} || '}}'), 1, 16) AS config_key FROM {', '.join(tables)}")
    return " UNION ALL ".join(parts)
