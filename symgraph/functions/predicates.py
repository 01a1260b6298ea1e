"""Classifications of symbols and paths as Column expressions. Literal lists are fixed values."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _any(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def _has(c: Column, words: list[str]) -> Column:
    return c.rlike(_any(words))


def _ends(c: Column, words: list[str]) -> Column:
    return c.rlike(f"(?:{_any(words)})$")


def slashes(file: Column) -> Column:
    return F.translate(file, "\\", "/")


def file_name(file: Column) -> Column:
    return F.substring_index(slashes(file), "/", -1)


# Test files: four rules that differ, for ranking, maps, command lines and audits.


def is_test_rank(file: Column) -> Column:
    f = F.lower(file)
    return _has(f, ["/test", "\\test", "/spec", "\\spec", "__test__", "_test.", ".test.", ".spec.", "/fixture", "/mock", "/stub", "/fake"]) | _ends(f, ["_test.go", "_test.py", "_test.rs", "test.ts", "test.js"])


def is_test_map(file: Column) -> Column:
    return _has(slashes(F.lower(file)), ["/test", "/spec", "/fixture", "/mock", "__tests__", ".test.", ".spec.", "_test."])


def is_test_cli(file: Column) -> Column:
    f = slashes(F.lower(file))
    folders = ["test", "tests", "spec", "specs", "fixture", "fixtures", "mock", "mocks", "__tests__", "__mocks__", "testfixtures"]
    ends = ["test.java", "tests.java", "test.rs", "test.ts", "test.tsx", "test.js", "test.jsx", "test.py", "test.go", "_test.go", "tests.cs", "test.cs", "_test.dart"]
    return f.rlike(f"(?:^|/)(?:{_any(folders)})(?:/|$)") | _ends(f, ends) | _has(f, [".spec.", ".test."]) | file_name(f).rlike(r"^(?:test_|conftest\.py$)")


def is_test_audit(file: Column) -> Column:
    return _has(F.lower(file), ["test", "spec"])


# Generated files: for maps, and for change lists of two origins.


def is_generated_map(file: Column) -> Column:
    f = slashes(F.lower(file))
    return _ends(f, [".min.js", ".min.css"]) | _has(f, [".chunk.", ".bundle.", "/dist/", "/build/", "/resources/monitor/", "/resources/static/", "/generated/"]) | file_name(f).rlike(r"^[^.]*\.[0-9a-f]{8,}\.")


def is_generated_change(path: Column, state_dir: str = ".symgraph") -> Column:
    """By whole folders of the path; ``state_dir`` is where this library keeps its state."""
    p = slashes(path)
    return p.rlike(f"(?:^|/){re.escape(state_dir)}/") | p.rlike(r"(?:^|/)(?:target|dist|build|\.dart_tool|generated)(?:/|$)") | _ends(p, [".g.dart", ".generated.rs", ".pb.go", ".designer.cs"])


def is_generated_tool_change(path: Column, state_dir: str = ".symgraph") -> Column:
    """By parts of the path wherever they stand, case-sensitive."""
    return _has(path, ["node_modules/", "target/", "dist/", "build/", f"{state_dir}/", "package-lock.json", "Cargo.lock", "generated/"]) | _ends(path, [".min.js", ".min.css"])


# Entry points and other roles by name.


def _callable(kind: Column) -> Column:
    return kind.isin("function", "method")


def is_entry_point(name: Column, kind: Column, file: Column) -> Column:
    n, f = F.lower(name), F.lower(file)
    handler = _ends(n, ["_view", "_handler", "_controller", "_endpoint"]) | n.rlike("^(?:handle_|get_|post_|put_|delete_|patch_)")
    routes = _has(f, ["route", "view", "handler", "controller", "endpoint", "api"])
    events = _has(n, ["webhook", "receive", "subscribe"]) | n.startswith("on_") | (n.startswith("handle") & ~f.contains("test"))
    jobs = (_has(n, ["job", "task", "worker", "cron"]) | n.endswith("_run") | n.isin("run", "execute", "process")) & _has(f, ["job", "task", "worker", "cron", "celery", "sidekiq", "background"])
    commands = n.contains("command") | n.endswith("_cmd") | n.isin("cli", "invoke")
    return _callable(kind) & (name.isin("main", "__main__") | (handler & routes) | events | jobs | commands)


def is_widget(name: Column, kind: Column) -> Column:
    return (kind == "class") & _ends(name, ["Widget", "State", "Page", "Screen", "View"])


def is_component(name: Column, kind: Column, file: Column) -> Column:
    return kind.isin("function", "class") & F.lower(file).endswith(".tsx") & name.rlike(r"^\p{Lu}")


def is_event_handler(name: Column, kind: Column) -> Column:
    n = F.lower(name)
    return _callable(kind) & (n.rlike("^(?:on|handle)") | _ends(n, ["handler", "callback", "listener"]))


def is_callback(name: Column) -> Column:
    n = F.lower(name)
    return _ends(n, ["fn", "callback", "handler"]) | n.startswith("on_")


def is_injected(name: Column) -> Column:
    n = F.lower(name)
    return _ends(n, ["factory", "provider", "injector", "container"]) | n.contains("singleton")


#: Parts of names that deserve a look in a security audit (fixed values).
SENSITIVE = "query exec eval write delete connect send request fetch open read_file spawn database sql db auth login password".split()


def is_sensitive(name: Column) -> Column:
    return _has(F.lower(name), SENSITIVE)


# Severity, confidence, roles, risk.


def severity_rank(hop: Column) -> Column:
    return F.when(hop <= 1, 0).when(hop <= 3, 1).otherwise(2)


def severity(hop: Column) -> Column:
    return F.when(hop <= 1, "direct").when(hop <= 3, "transitive").otherwise("distant")


def confidence(up: Column, down: Column) -> Column:
    total = up + down
    return (
        F.when(total == 0, "Low").when((up == 0) & (down > 5), "Medium").when((up == 0) | (down == 0), "High").when(total > 50, "Low").when(total > 20, "Medium").otherwise("High")
    )


def node_role(up: Column, down: Column) -> Column:
    adapter = ((up <= 2) & (down > 5)) | ((up > 5) & (down <= 2))
    return F.when((up == 0) & (down == 0), "Isolated").when(up == 0, "Entry Point").when(down == 0, "Utility").when(adapter, "Adapter").otherwise("Core Logic")


def simple_role(up: Column, down: Column) -> Column:
    """Roles without adapters."""
    return F.when((up == 0) & (down == 0), "Isolated").when(up == 0, "Entry Point").when(down == 0, "Utility").otherwise("Core Logic")


def simple_confidence(total: Column) -> Column:
    """Goes with :func:`simple_role`: low if nothing is known to be affected."""
    return F.when(total == 0, "Low (no edges found)").otherwise("High")


def degree_role(entry: Column, callers: Column, callees: Column) -> Column:
    return F.when(entry, "entry_point").when(callers == 0, "unreachable").when(callees == 0, "utility").otherwise("internal")


def risk_level(affected: Column) -> Column:
    return F.when(affected > 50, "critical").when(affected > 25, "high").when(affected > 10, "medium").otherwise("low")


def path_severity(length: Column) -> Column:
    return F.when(length <= 2, "critical").when(length <= 4, "high").when(length <= 6, "medium").otherwise("low")


def review_level(centrality: Column, entry: Column, callers: Column) -> Column:
    return F.when((centrality > 0.3) | entry | (callers > 10), "High").when((centrality > 0.1) | (callers > 3), "Medium").otherwise("Low")


def change_class(path: Column) -> Column:
    p = F.lower(path)
    return F.when(_has(p, ["test", "spec"]), "test").when(p.endswith(".md") | p.contains("docs/"), "doc").when(_has(p, ["cargo.toml", "dockerfile", ".github/"]), "infra").otherwise("code")


# Sizes and short forms.


def token_estimate(name: Column, qualified_name: Column, file: Column, signature: Column, line_start: Column, line_end: Column) -> Column:
    """A quarter of the bytes of what describes a symbol, and ten tokens a line, rounded up."""
    text = sum((F.octet_length(F.coalesce(c, F.lit(""))) for c in (name, qualified_name, file, signature)), F.lit(0))
    lines = F.greatest(line_end - line_start, F.lit(0)) + 1
    return F.ceil((text + lines * 40) / 4).cast("long")


def compress_path(file: Column, root: str = "") -> Column:
    """The path below ``root``; of more than four parts the first and the last three."""
    f = slashes(file)
    if root:
        prefix = root.rstrip("/") + "/"
        f = F.when(f.startswith(prefix), F.substring(f, len(prefix) + 1, 1_000_000)).otherwise(f)
    parts = F.split(f, "/")
    return F.when(F.size(parts) > 4, F.concat(parts[0], F.lit("/.../"), F.array_join(F.slice(parts, -3, 3), "/"))).otherwise(f)


def _parameters(text: str) -> list[str]:
    """The names between the commas that stand in no brackets: the word before a colon, else the last."""
    parts, depth, part = [], 0, []
    for c in text + ",":
        if c == "," and depth == 0:
            parts.append("".join(part))
            part = []
            continue
        depth += {"<": 1, "(": 1, ">": -1, ")": -1}.get(c, 0)
        part.append(c)
    words = [p.split(":", 1)[0].split() for p in parts]
    return [w[-1] for w in words if w]


def _short(signature: str) -> str:
    text, most = signature.strip(), 80
    opened, closed = text.find("("), text.rfind(")")
    if opened < 0:
        return text if len(text.encode()) <= most else text[: most - 3] + "..."
    name = (text[:opened].split() or [text[:opened]])[-1]
    if closed < opened:
        return f"{name}(...)"
    out = f"{name}({', '.join(_parameters(text[opened + 1 : closed]))})"
    return out if len(out.encode()) <= most else f"{name}(...)"


@F.pandas_udf(StringType())
def short_signature(signatures: pd.Series) -> pd.Series:
    """``name(parameter names)`` of a signature, ``name(...)`` beyond 80 bytes."""
    return signatures.map(_short, na_action="ignore")
