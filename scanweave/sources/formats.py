"""Which declared layout a folder of files has, told by the names in it.

Rules are declared by the caller, a handful of patterns each. Every folder is aggregated once, with
a flag for each distinct pattern, so no file is compared with rules by a join;
what a folder's parents hold, all of them, comes by a join of its ancestors with the places that hold it.
"""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

V = F.col


@dataclass(frozen=True)
class Rule:
    """A layout's name and its checks; each kind of check that has patterns counts once.

    ``files``: every pattern has a file in the folder. ``folders``: every pattern has a folder in it. ``around``: every
    pattern has an entry in one and the same of the folder and all its parents. ``only``: every file of the folder fits one
    of the patterns.
    """

    name: str
    files: tuple[str, ...] = ()
    folders: tuple[str, ...] = ()
    around: tuple[str, ...] = ()
    only: tuple[str, ...] = ()

    def checks(self) -> dict[str, tuple[str, ...]]:
        return {k: getattr(self, k) for k in ("files", "folders", "around", "only") if getattr(self, k)}


@dataclass
class _Flags:
    """The aggregates of a folder: one for each pattern and kind of entry."""

    names: dict[tuple[str, tuple[str, ...]], str] = field(default_factory=dict)

    def of(self, kind: str, patterns: tuple[str, ...]) -> Column:
        return V(self.names.setdefault((kind, patterns), f"__f{len(self.names)}"))

    def aggregates(self) -> list[Column]:
        out = []
        for (kind, patterns), name in self.names.items():
            fits = _fits(patterns)
            found = {
                "files": F.bool_or(fits & ~V("is_folder")), "folders": F.bool_or(fits & V("is_folder")), "around": F.bool_or(fits), "only": F.bool_and(fits | V("is_folder"))
            }[kind]
            out.append(found.alias(name))
        return out


def _fits(patterns: tuple[str, ...]) -> Column:
    """Whether an entry's name fits one of the shell patterns; Java and Python agree on these expressions."""
    whole = "|".join(fnmatch.translate(p).removesuffix("\\z").removesuffix("\\Z") for p in patterns)
    return V("name").rlike(f"^(?:{whole})$")


def scores(entries: DataFrame, rules: list[Rule]) -> DataFrame:
    """``folder, rule, score, specificity, rank`` of every folder of ``entries(folder, name, is_folder)`` and rule.

    The score is the share of a rule's checks that hold. Rank 1 is the best: the highest score, then the rule with more patterns, then the
    last name. Folder names are paths with ``/``. Rules without a check match nothing.
    """
    named = [r for r in rules if r.checks()]
    if len({r.name for r in named}) < len(named):
        raise ValueError("two rules have the same name")
    flags, around = _Flags(), sorted({r.around for r in named if r.around})
    own, near = [], {}
    for patterns in around:
        near[patterns] = F.lit(True)
        for p in patterns:
            near[patterns] = near[patterns] & flags.of("around", (p,))
    for r in named:
        held = []
        for kind, patterns in r.checks().items():
            if kind == "around":
                held.append(F.coalesce(V(f"__near{around.index(patterns)}"), F.lit(False)))
            elif kind == "only":
                held.append(flags.of(kind, patterns))
            else:
                one = F.lit(True)
                for p in patterns:
                    one = one & flags.of(kind, (p,))
                held.append(one)
        share = sum((h.cast("int") for h in held), F.lit(0)) / len(held)
        size = sum(map(len, r.checks().values()))
        own.append(F.struct(F.lit(r.name).alias("rule"), share.cast("double").alias("score"), F.lit(size).alias("specificity")))
    folders = entries.groupBy("folder").agg(*flags.aggregates(), F.count("*").alias("__n"))
    if around:
        seen = {f"__near{k}": c for k, c in enumerate(near.values())}
        here = folders.select(V("folder").alias("place"), *[c.alias(n) for n, c in seen.items()]).filter(F.array_contains(F.array(*seen), True))
        depths = folders.select("folder", F.explode(F.sequence(F.lit(1), F.size(F.split("folder", "/")))).alias("__depth"))
        chain = depths.select("folder", F.call_function("substring_index", V("folder"), F.lit("/"), V("__depth")).alias("place"))
        held = chain.join(here, "place").groupBy("folder").agg(*[F.bool_or(n).alias(n) for n in seen])
        folders = folders.join(held, "folder", "left")
    spread = folders.select("folder", F.inline(F.array(*own)))
    best = Window.partitionBy("folder").orderBy(F.desc("score"), F.desc("specificity"), F.desc("rule"))
    return spread.withColumn("rank", F.row_number().over(best))


def best(entries: DataFrame, rules: list[Rule]) -> DataFrame:
    """``folder, rule``: the best rule of which every check holds; null where there is none."""
    found = scores(entries, rules).filter("rank = 1")
    return found.select("folder", F.when(V("score") >= 1.0, V("rule")).alias("rule"))
