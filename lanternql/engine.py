"""Parse, check and run queries."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from .errors import QueryError
from .functions.expressions import Functions, Options
from .operators.select import Lowering
from .plans.parser import Extensions, Parser
from .plans.resolve import assemble
from .plans.typecheck import check_types
from .sources.catalog import Catalog
from .streaming.cursor import Cursor


def parse(text: str, extensions: Extensions | None = None):
    """The plan of a text: fragments spliced, bindings and declared types checked."""
    plan = assemble(*Parser(text, extensions).document())
    check_types(plan)
    return plan


class Engine:
    """Runs plans over a catalog.

    ``strict_nulls``: a null in an ordinary comparison or an aggregate is an error, as against SQL's unknown.
    ``exact_output``: how quotients come out: ``double``, ``string`` (``n/d``) or ``struct``.
    ``preserve_order``: rows without ORDER BY come in source order, groups by their first row, at the price of a
    sort; set operations have no order either way.
    """

    def __init__(self, catalog: Catalog, strict_nulls: bool = True, exact_output: str = "double", functions: Functions | None = None, extensions: Extensions | None = None, preserve_order: bool = False):
        self.catalog, self.strict, self.exact = catalog, strict_nulls, exact_output
        self.functions = functions or Functions()
        self.extensions, self.ordered = extensions, preserve_order

    def plan(self, query):
        if isinstance(query, str):
            return parse(query, self.extensions)
        return query.plan() if hasattr(query, "plan") else query

    def run(self, query, params: dict | None = None, time_field: tuple[str, ...] | None = None) -> DataFrame:
        """A text, a builder or a plan as a DataFrame; nothing but recursive bindings runs yet."""
        plan = self.plan(query)
        options = Options(params or {}, self.strict, self.exact, self.ordered, self.functions)
        try:
            return Lowering(self.catalog, options, plan.withs, time_field, plan.types).run(plan)
        except PySparkException as e:
            raise QueryError("analysis", str(e)) from e

    def rows(self, query, params: dict | None = None, time_field=None) -> Cursor:
        return Cursor(self.run(query, params, time_field))

    def check(self, query) -> None:
        """Check a query against its sources' live schemas too."""
        check_types(self.plan(query), self.catalog)
