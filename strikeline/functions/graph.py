"""Row columns as a graph: each is defined once in terms of others, and what is wanted is built in few selects.

A definition is a SQL expression: a select of a hundred of them is one call to the JVM, where the same as Column objects is some thousand calls. It gets the columns it
reads as attributes of its first argument, which is how its dependencies are known. Only what is wanted, directly or not, is
built. Columns of one depth share a select, or a few where that would be too much for one generated method. Packed, a column that no later select reads is put into
a struct right away, which later selects copy as one value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from strikeline.functions.mathx import apart
from strikeline.params import Params


class Reader:
    """The columns that a definition reads; `given` is a column that the rows had before under the defined name or another one."""

    def __init__(self, base: set[str], defined: set[str]):
        self._base, self._defined, self.read = base, defined, set()

    def __getattr__(self, name: str) -> str:
        self.read.add(name)
        return f"`{name}`"

    def __getitem__(self, name: str) -> str:
        return getattr(self, name)

    def given(self, name: str) -> str | None:
        if name not in self._base:
            return None
        return self[GIVEN + name if name in self._defined else name]


Definition = Callable[[Reader, Params], str]
Definitions = dict[str, Definition]
GIVEN = "_given_"
#: How much code one generated method may get, in characters of expressions, and how much the rows that come in are taken to have.
METHOD, BELOW = 4600, 1800
#: Spark makes no common method of selects of more columns.
FUSED = 100


def _resolve(base: set[str], definitions: Definitions, wanted: Iterable[str], params: Params) -> tuple[dict[str, str], dict[str, set[str]], dict[str, int]]:
    """Expression, dependencies and depth of everything that wanted columns need; base columns have depth 0."""
    made, needs, depth = {}, {}, {}
    defined = set(definitions)

    def visit(name: str) -> int:
        if name in depth:
            return depth[name]
        if name not in definitions:
            if name not in base and name.removeprefix(GIVEN) not in base:
                raise KeyError(f"no column and no definition of {name}")
            depth[name] = 0
            return 0
        reader = Reader(base, defined)
        made[name], needs[name] = definitions[name](reader, params), reader.read
        depth[name] = 1 + max((visit(x) for x in sorted(needs[name])), default=0)
        return depth[name]

    for name in wanted:
        visit(name)
    return made, needs, depth


def _steps(made: dict[str, str], depth: dict[str, int]) -> list[list[str]]:
    """Columns to be made by each select, in order: those of one depth, in several selects where that is too much for one method."""
    steps = []
    for k in sorted({depth[n] for n in made}):
        room = 0
        for n in (n for n in made if depth[n] == k):
            size = len(made[n])
            if room < size:
                steps.append([])
                room = METHOD - BELOW
            steps[-1].append(n)
            room -= size
    return steps


def build(df: DataFrame, definitions: Definitions, params: Params, wanted: Iterable[str] | None = None, only: bool = False, packed: bool = False) -> DataFrame:
    """df with the wanted columns (all that have no leading underscore, by default), or, with `only`, just these. Defined columns that df has are
    replaced. Where rows are filtered by what is built, they are better not packed: the filter would be rewritten in terms of whole structs."""
    wanted = list(dict.fromkeys(wanted if wanted is not None else (d for d in definitions if not d.startswith("_"))))
    base = set(df.columns)
    made, needs, depth = _resolve(base, definitions, wanted, params)
    outputs = wanted if only else [c for c in df.columns if c not in made] + wanted
    ends = set(outputs)
    read = ends.union(*needs.values())
    standing = {x: f"`{x.removeprefix(GIVEN)}` AS `{x}`" for x in [*df.columns, *(GIVEN + c for c in df.columns)] if x in read and x not in made}
    stored: dict[str, str] = {}  # finished column: where it stands
    structs: list[str] = []
    code, steps = BELOW, _steps(made, depth)
    for k, new in enumerate(steps):
        later = {x for own in steps[k + 1 :] for n in own for x in needs[n]}
        size = sum(len(made[n]) for n in new) + 24 * len(standing)
        if code + size > METHOD and len(standing) + len(structs) <= FUSED:
            df, code = apart(df), 0
        code += size
        standing |= {n: f"{made[n]} AS `{n}`" for n in new}
        if k + 1 == len(steps):
            break
        done, kept = [n for n in standing if n not in later and n in ends], [n for n in standing if n in later]
        if packed and done:
            name = f"_done{k}"
            df = df.selectExpr(*(standing[n] for n in kept), _struct(standing, done, name), *structs)
            structs.append(name)
            stored |= {n: name for n in done}
        else:
            kept += done
            df = df.selectExpr(*(standing[n] for n in kept), *structs)
        standing = {n: f"`{n}`" for n in kept}
    value = {n: f"{stored[n]}.`{n}` AS `{n}`" if n in stored else standing[n] for n in outputs}
    return df.selectExpr(*value.values())


def _struct(texts: dict[str, str], names: list[str], name: str) -> str:
    return f"struct({', '.join(texts[n] for n in names)}) AS {name}"
