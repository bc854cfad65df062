"""Reading many paths of JSON in one pass, by the types that its values have.

Every accessor notes its path and gives a short reference to an array element. `over` then parses a row once into just these
paths, each a VARIANT that still knows its type (a typed JSON reader turns a number where a text is asked for into text), and adds the typed arrays
below a generator, which the optimizer does not merge with the projections and filters above it. So a row is read once, however many
paths there are and however often a value is used, and plans stay as small as the expressions that were written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, VariantType


def whole_text(x: Column) -> Column:
    """A VARIANT's text; null for other types."""
    return F.when(x.isNotNull() & (F.schema_of_variant(x) == "STRING"), F.try_variant_get(x, "$", "string"))


def whole_number(x: Column) -> Column:
    """A VARIANT's finite number; null for other types, numbers in quotes too."""
    value = F.try_variant_get(x, "$", "double")
    return F.when(x.isNotNull() & ~F.schema_of_variant(x).isin("STRING", "BOOLEAN") & ~F.isnan(value) & (F.abs(value) != float("inf")), value)


def whole_flag(x: Column) -> Column:
    return F.when(x.isNotNull() & (F.schema_of_variant(x) == "BOOLEAN"), F.try_variant_get(x, "$", "boolean"))


def filled(c: Column) -> Column:
    """A text that is not empty."""
    return F.when(c != "", c)


#: Paths of a kind that are typed one by one.
FEW = 12


def _same_but_case(tree: dict) -> bool:
    """Whether an object has names that differ only in case."""
    return len({n.lower() for n in tree}) < len(tree) or any(_same_but_case(x) for x in tree.values() if x)


class Leaves:
    """Paths into one column of JSON texts, or of VARIANT. Texts that are no JSON objects have nothing at any path."""

    KINDS = {"texts": whole_text, "numbers": whole_number, "flags": whole_flag, "raw": lambda x: x}

    def __init__(self, column: str = "value"):
        self.column = column
        self.paths: dict[str, dict[str, int]] = {kind: {} for kind in self.KINDS}

    def _at(self, kind: str, path: str) -> Column:
        own = self.paths[kind]
        return F.col(f"__{self.column}_{kind}")[own.setdefault(path, len(own))]

    def text(self, path: str) -> Column:
        return self._at("texts", path)

    def number(self, path: str) -> Column:
        return self._at("numbers", path)

    def flag(self, path: str) -> Column:
        return self._at("flags", path)

    def raw(self, path: str) -> Column:
        """What is at a path as VARIANT, a JSON null too."""
        return self._at("raw", path)

    def first_text(self, *paths: str) -> Column:
        """The first text at the paths that is not empty."""
        return F.coalesce(*(filled(self.text(p)) for p in paths))

    def _tree(self) -> dict:
        """The paths as nested names; a path that is the beginning of others is a leaf, from which those are looked up."""
        leaves = sorted({tuple(p.split(".")) for own in self.paths.values() for p in own}, key=len)
        tree: dict = {}
        for path in leaves:
            at, fits = tree, True
            for name in path[:-1]:
                at = at.setdefault(name, {})
                if at is None:
                    fits = False
                    break
            if fits:
                at.setdefault(path[-1], None)
        return tree

    def over(self, rows: DataFrame) -> DataFrame:
        """The rows with the arrays that all accessors called so far refer to."""
        if not any(self.paths.values()):
            return rows
        if isinstance(rows.schema[self.column].dataType, VariantType):
            return rows.select("*", F.inline(F.array(self._arrays(lambda path: F.try_variant_get(F.col(self.column), f"$.{path}", "variant")))))
        tree, parsed = self._tree(), f"__{self.column}_parsed"
        # names that differ only in case are told apart by place, which copies what was read
        placed = _same_but_case(tree)
        shape = lambda node, name: VariantType() if node is None else StructType([StructField(name(k, n), shape(x, name)) for k, (n, x) in enumerate(node.items())])

        def look(path: str) -> Column:
            names, node, k, held = path.split("."), tree, 0, F.col(parsed)
            while node is not None and k < len(names):
                held, node, k = held[f"f{list(node).index(names[k])}" if placed else names[k]], node[names[k]], k + 1
            return held if k == len(names) else F.try_variant_get(held, f"$.{'.'.join(names[k:])}", "variant")

        text = F.trim(self.column)
        read = F.from_json(text, shape(tree, lambda _, n: n))
        read = F.when(text.startswith("{"), read.cast(shape(tree, lambda k, _: f"f{k}")) if placed else read)
        once = rows.select("*", F.inline(F.array(F.struct(read.alias(parsed)))))
        return once.select("*", F.inline(F.array(self._arrays(look)))).drop(parsed)

    def _arrays(self, look: Callable[[str], Column]) -> Column:
        # few values are typed one by one, which is compiled; many by a lambda, which keeps the code small
        typed = lambda own, f: F.array(*(f(look(p)) for p in own)) if len(own) <= FEW else F.transform(F.array(*map(look, own)), f)
        return F.struct(*(typed(own, self.KINDS[kind]).alias(f"__{self.column}_{kind}") for kind, own in self.paths.items() if own))
