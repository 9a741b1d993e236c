"""Transitive closure over an import graph.

Recursive SQL in Spark takes only UNION ALL, which never ends on a cycle, so the frontier is advanced by
join and anti-join until it is empty.  Each round is written to the shared folder, which keeps the
plan short and survives a lost executor; the driver sees only whether the frontier is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import materialize


def is_third_party(path: Column, module: Column) -> Column:
    """Not of the standard library: has a module, or a dot in its first segment."""
    return module.isNotNull() | F.split(path, "/")[0].contains(".")


def dependencies(imports: DataFrame, roots: DataFrame, root_module: str, transitive: bool = True) -> DataFrame:
    """(pkg_path): packages imported by ``roots(pkg_path)``, directly or over any number of steps.

    ``imports(pkg_path, import_path[, module])``.  Standard packages and those whose path starts
    with ``root_module`` are left out, and nothing is reached through them; an empty ``root_module`` leaves out none.  Cycles end.
    """
    module = F.col("module") if "module" in imports.columns else F.lit(None).cast("string")
    keep = is_third_party(F.col("import_path"), module)
    if root_module:
        keep &= ~F.col("import_path").startswith(root_module)
    edges = materialize(imports.where(keep).select("pkg_path", "import_path").distinct(), "imports")
    step = lambda f: f.join(edges, "pkg_path").select(F.col("import_path").alias("pkg_path")).distinct()
    seen = frontier = materialize(step(roots.select("pkg_path").distinct()), "frontier")
    while transitive:
        frontier = materialize(step(frontier).join(seen, "pkg_path", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)  # the written frontiers side by side; none is written again
    return seen
