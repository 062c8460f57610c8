"""Source facts: imports, exports, classes, functions, contracts, triggers, entry point, barrel.

Python sources go through the standard library's `ast`.  TypeScript,
JavaScript and Kotlin have no parser here; a scanner blanks comments and keeps
strings, and patterns with bracket matching read declarations (nested or
computed syntax beyond these forms is not seen).

An extractor is a callable (source, path) -> dict of FACTS; `register` adds one.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from os.path import basename

TRIGGER = "array<struct<trigger_type: string, method: string, route: string, command: string, args: array<string>>>"
FACTS = (
    "imports array<struct<module: string, names: array<string>, alias: string, is_external: boolean>>, "
    "exports array<string>, "
    "classes array<struct<name: string, bases: array<string>, methods: array<string>, decorators: array<string>, docstring: string>>, "
    f"functions array<struct<name: string, parameters: array<string>, return_type: string, is_async: boolean, decorators: array<string>, docstring: string, triggers: {TRIGGER}>>, "
    "contracts array<struct<name: string, contract_type: string, fields: array<struct<name: string, type: string, optional: boolean>>>>, "
    "entry_point_type string, is_barrel boolean"
)
HTTP_METHODS = ("get", "post", "put", "delete", "patch", "head", "options")
EXTRACTORS: dict[str, Callable[[str, str], dict]] = {}


def register(*languages: str):
    def add(f):
        EXTRACTORS.update(dict.fromkeys(languages, f))
        return f

    return add


def trigger(kind: str, method: str | None = None, route: str | None = None, command: str | None = None, args: list[str] | None = None) -> dict:
    return {"trigger_type": kind, "method": method, "route": route, "command": command, "args": args or []}


def export_list(facts: dict) -> list[str]:
    """Everything a file offers, each name once, in order."""
    return sorted({*facts["exports"], *(c["name"] for c in facts["classes"]), *(f["name"] for f in facts["functions"])})


# ---- Python


def _text(node: ast.AST | None) -> str | None:
    return None if node is None else ast.unparse(node)


def _module(node: ast.ImportFrom) -> str:
    return "." * node.level + (node.module or "")


def internal(module: str) -> bool:
    return not module or module.startswith((".", "src.", "src/"))


def _route_args(call: ast.Call) -> tuple[str | None, list[str]]:
    route = next((a.value for a in call.args if isinstance(a, ast.Constant) and isinstance(a.value, str)), None)
    listed = next((k.value for k in call.keywords if k.arg == "methods"), None)
    return route, [e.value for e in getattr(listed, "elts", []) if isinstance(e, ast.Constant)]


def python_triggers(decorators: list[ast.expr]) -> list[dict]:
    out = []
    for call in (d for d in decorators if isinstance(d, ast.Call)):
        name, (route, methods) = ast.unparse(call.func).lower(), _route_args(call)
        verb = name.rsplit(".", 1)[-1]
        if "." in name and verb in HTTP_METHODS:
            out.append(trigger("http", verb.upper(), route or "/"))
        elif verb == "route":
            out += [trigger("http", m.upper(), route or "/") for m in methods or (["GET"] if route else [])]
        if ".command" in name:
            out.append(trigger("cli", command=route))
    return out


def _python_function(node: ast.FunctionDef | ast.AsyncFunctionDef) -> dict:
    a = node.args
    named = [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]
    return {
        "name": node.name,
        "parameters": [p.arg + (f": {_text(p.annotation)}" if p.annotation else "") for p in named if p.arg not in ("self", "cls")],
        "return_type": _text(node.returns),
        "is_async": isinstance(node, ast.AsyncFunctionDef),
        "decorators": [ast.unparse(d) for d in node.decorator_list],
        "docstring": ast.get_docstring(node),
        "triggers": python_triggers(node.decorator_list),
    }


def _python_contract(node: ast.ClassDef) -> dict | None:
    decorators, bases = [ast.unparse(d) for d in node.decorator_list], [ast.unparse(b) for b in node.bases]
    kind = "dataclass" if any("dataclass" in d for d in decorators) else "model" if any(b.endswith(("BaseModel", "Schema")) for b in bases) else "typeddict" if any(b.endswith("TypedDict") for b in bases) else None
    if kind is None:
        return None
    fields = []
    for item in node.body:
        if isinstance(item, ast.AnnAssign) and isinstance(item.target, ast.Name):
            kind_text = ast.unparse(item.annotation)
            # a default that is a bare name does not make a field optional
            default = item.value is not None and not isinstance(item.value, ast.Name)
            fields.append({"name": item.target.id, "type": kind_text, "optional": "Optional" in kind_text or kind_text.endswith("| None") or default})
        elif isinstance(item, ast.Assign) and isinstance(item.targets[0], ast.Name):
            fields.append({"name": item.targets[0].id, "type": "Any", "optional": not isinstance(item.value, ast.Name)})
    return {"name": node.name, "contract_type": kind, "fields": fields}


def _python_entry(tree: ast.Module, source: str, name: str, modules: set[str]) -> str | None:
    guards = (ast.unparse(n.test) for n in ast.walk(tree) if isinstance(n, ast.If) and isinstance(n.test, ast.Compare))
    if any("__name__" in g and "__main__" in g for g in guards):
        return "main"
    if modules & {"click", "typer", "argparse"}:
        return "cli"
    if ("fastapi" in modules and re.search("FastAPI|APIRouter", source)) or ("flask" in modules and re.search(r"Flask\(|@(app|bp)\.route", source)):
        return "api_route"
    return "main" if name in ("main.py", "app.py", "run.py", "cli.py", "__main__.py") else None


def _python_barrel(tree: ast.Module, name: str) -> bool:
    if name != "__init__.py":
        return False
    imports = (ast.Import, ast.ImportFrom)
    assigned = lambda n: isinstance(n, ast.Assign) and ast.unparse(n.targets[0]) == "__all__"
    said = lambda n: isinstance(n, ast.Expr) and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str)
    real = (ast.Expr, ast.Assign, ast.AnnAssign, ast.AugAssign, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
    return any(isinstance(n, imports) for n in tree.body) and not any(isinstance(n, real) and not assigned(n) and not said(n) for n in tree.body)


@register("python")
def python_facts(source: str, path: str) -> dict:
    """Raises SyntaxError for a source that is no Python."""
    tree = ast.parse(source)
    imports = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            imports += [{"module": a.name, "names": [], "alias": a.asname, "is_external": not internal(a.name)} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            imports.append({"module": _module(node), "names": [a.name for a in node.names], "alias": None, "is_external": not internal(_module(node))})
    functions = [n for n in tree.body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
    classes = [n for n in tree.body if isinstance(n, ast.ClassDef)]
    listed = next((n.value for n in tree.body if isinstance(n, ast.Assign) and ast.unparse(n.targets[0]) == "__all__"), None)
    public = [n.name for n in tree.body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) and not n.name.startswith("_")]
    name = basename(path)
    return {
        "imports": imports,
        "exports": [e.value for e in listed.elts if isinstance(e, ast.Constant)] if isinstance(listed, ast.List | ast.Tuple) else public,
        "classes": [{"name": c.name, "bases": [ast.unparse(b) for b in c.bases], "methods": [m.name for m in c.body if isinstance(m, ast.FunctionDef | ast.AsyncFunctionDef)], "decorators": [ast.unparse(d) for d in c.decorator_list], "docstring": ast.get_docstring(c)} for c in classes],
        "functions": [_python_function(f) for f in functions],
        "contracts": [c for c in map(_python_contract, classes) if c],
        "entry_point_type": _python_entry(tree, source, name, {i["module"] for i in imports}),
        "is_barrel": _python_barrel(tree, name),
    }


# ---- a scanner for curly languages


def without_comments(source: str) -> str:
    """Comments as blanks of the same length; strings stay."""
    blank = lambda m: m[0] if m[0][0] in "\"'`" else re.sub(r"[^\n]", " ", m[0])
    return re.sub(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|//[^\n]*|/\*.*?\*/", blank, source, flags=re.S)


def body_at(source: str, start: int, pair: str = "{}") -> str:
    """What stands between the next opening bracket and its partner."""
    at = source.find(pair[0], start)
    if at < 0:
        return ""
    depth = 0
    for m in re.compile(f"[{re.escape(pair)}]").finditer(source, at):
        depth += 1 if m[0] == pair[0] else -1
        if depth == 0:
            return source[at + 1 : m.start()]
    return source[at + 1 :]


def split_top(text: str, mark: str = ",") -> list[str]:
    """Parts between marks that stand in no bracket."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        if c in "([{<":
            depth += 1
        elif c in ")]}" or (c == ">" and text[i - 1 : i] not in ("=", "-")):
            depth -= 1
        elif c == mark and depth <= 0:
            out.append(text[last:i])
            last = i + 1
    return [p.strip() for p in [*out, text[last:]] if p.strip()]


# ---- TypeScript and JavaScript


def _ts_function(name: str, source: str, start: int, is_async: bool) -> dict:
    parameters = body_at(source, start, "()")
    after = source[source.find("(", start) + len(parameters) + 2 :][:200]
    returns = re.match(r"\s*:\s*([^={]+?)\s*(=>|\{)", after)
    return {"name": name, "parameters": split_top(parameters), "return_type": returns[1].strip() if returns else None, "is_async": is_async, "decorators": [], "docstring": None, "triggers": [trigger("http", name, "[dynamic]")] if name in {m.upper() for m in HTTP_METHODS} else []}


def _ts_fields(body: str) -> list[dict]:
    out = []
    for part in re.split(r"[;\n,](?![^{(<]*[})>])", body):
        if m := re.match(r"\s*(?:readonly\s+)?(\w+)(\??)\s*:\s*(.+?)\s*$", part, re.S):
            out.append({"name": m[1], "type": m[3], "optional": bool(m[2])})
    return out


@register("typescript", "javascript")
def typescript_facts(source: str, path: str) -> dict:
    code, name = without_comments(source), basename(path).lower()
    imports = []
    for m in re.finditer(r"^\s*import\s+(?:type\s+)?(?:([^'\";]*?)\s+from\s+)?['\"]([^'\"]+)['\"]", code, re.M):
        what = m[1] or ""
        named = re.search(r"\{([^}]*)\}", what)
        names = [re.sub(r"^type\s+", "", p).split(" as ")[0].strip() for p in split_top(named[1])] if named else []
        star = re.search(r"\*\s+as\s+(\w+)", what)
        default = re.match(r"\s*(\w+)", what)
        imports.append({"module": m[2], "names": ([default[1]] if default else []) + names, "alias": star[1] if star else None, "is_external": not m[2].startswith(".")})
    imports += [{"module": m[1], "names": [], "alias": None, "is_external": not m[1].startswith(".")} for m in re.finditer(r"\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)", code)]
    exports = [m[1] for m in re.finditer(r"^\s*export\s+(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\*?|class|interface|type|enum|const|let|var)\s+(\w+)", code, re.M)]
    for m in re.finditer(r"^\s*export\s*(?:type\s*)?\{([^}]*)\}(\s*from)?", code, re.M):
        if not m[2]:
            exports += [p.split(" as ")[-1].strip() for p in split_top(m[1])]
    classes = []
    for m in re.finditer(r"\bclass\s+(\w+)(?:<[^{]*?>)?(?:\s+extends\s+([\w.]+))?(?:<[^{]*?>)?(?:\s+implements\s+([^{]+))?\s*\{", code):
        body = body_at(code, m.end() - 1)
        methods = [x[1] for x in re.finditer(r"^\s*(?:(?:public|private|protected|static|async|override|get|set)\s+)*(\w+)\s*(?:<[^>]*>)?\([^;{}]*\)[^;{}=]*\{", body, re.M) if x[1] not in ("if", "for", "while", "switch", "catch", "function", "return")]
        classes.append({"name": m[1], "bases": [b for b in [m[2], *split_top(m[3] or "")] if b], "methods": methods, "decorators": [], "docstring": None})
    functions = [_ts_function(m[2], code, m.end() - 1, bool(m[1])) for m in re.finditer(r"^(?:export\s+)?(?:default\s+)?(async\s+)?function\*?\s+(\w+)\s*(?:<[^(]*>)?\(", code, re.M)]
    functions += [_ts_function(m[1], code, m.end() - 1, bool(m[2])) for m in re.finditer(r"^(?:export\s+)?(?:const|let|var)\s+(\w+)(?:\s*:[^=]+)?\s*=\s*(async\s+)?\((?=[^;]*?=>)", code, re.M)]
    contracts = [{"name": m[1], "contract_type": "interface", "fields": _ts_fields(body_at(code, m.end() - 1))} for m in re.finditer(r"\binterface\s+(\w+)[^{]*\{", code)]
    contracts += [{"name": m[1], "contract_type": "type", "fields": []} for m in re.finditer(r"^\s*(?:export\s+)?type\s+(\w+)(?:<[^=]*>)?\s*=", code, re.M)]
    contracts += [{"name": m[1], "contract_type": "enum", "fields": [{"name": p.split("=")[0].strip(), "type": "enum", "optional": False} for p in split_top(body_at(code, m.end() - 1))]} for m in re.finditer(r"\benum\s+(\w+)\s*\{", code)]
    if functions:
        # triggers have no function of their own: the first one holds them
        routes = re.finditer(rf"\.({'|'.join(HTTP_METHODS)})\(\s*(?:['\"]([^'\"]+)['\"]|(`[^`]*`))", code, re.I)
        functions[0]["triggers"] += [trigger("http", m[1].upper(), m[2] or m[3]) for m in routes]
        functions[0]["triggers"] += [trigger("cli", command=m[1].split()[0], args=m[1].split()[1:]) for m in re.finditer(r"\.command\(\s*['\"]([^'\"]+)['\"]", code) if m[1].split()]
    statements = [s for s in (x.strip() for x in re.split(r";|\n(?=\s*(?:export|import|const|let|var|function|class)\b)", code)) if s]
    reexports = [s for s in statements if re.match(r"(export\s+(type\s+)?(\*|\{)[\s\S]*from\b|import\b)", s)]
    barrel = name.startswith("index.") and bool(statements) and len(reexports) == len(statements) and any(s.startswith("export") for s in statements)
    entry = None
    if name in ("index.ts", "index.js", "main.ts", "main.js", "app.ts", "app.js") and not barrel:
        entry = "main"
    elif any(p in source.lower() for p in ("app.get", "app.post", "app.put", "app.delete", "router.get", "router.post")) or (re.search(r"export default function|export async function", source) and any(x in name for x in ("page.", "route.", "[", "+"))):
        entry = "api_route"
    elif any(p in source for p in ("commander", "yargs", "meow")):
        entry = "cli"
    return {"imports": imports, "exports": exports, "classes": classes, "functions": functions, "contracts": contracts, "entry_point_type": entry, "is_barrel": barrel}


# ---- Kotlin


@register("kotlin")
def kotlin_facts(source: str, path: str) -> dict:
    code, name = without_comments(source), basename(path).lower()
    imports = [{"module": m[1], "names": [m[1].rsplit(".", 1)[-1]], "alias": m[2], "is_external": True} for m in re.finditer(r"^\s*import\s+([\w.*]+)(?:\s+as\s+(\w+))?", code, re.M)]
    top = re.sub(r"\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}", "{}", code)
    hidden = r"(?:private|internal)\b"
    exports = [m[2] for m in re.finditer(r"^((?:@\w+(?:\([^)]*\))?\s+|\w+\s+)*?)(?:class|interface|object|fun|val|var)\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?(\w+)", top, re.M) if not re.search(hidden, m[1])]
    classes, contracts = [], []
    for m in re.finditer(r"^\s*((?:(?:@\w+(?:\([^)]*\))?|\w+)\s+)*?)(class|interface|object)\s+(\w+)(?:<[^>]*>)?", code, re.M):
        words = m[1].split()
        rest = code[m.end() :]
        params = body_at(rest, 0, "()") if rest.lstrip().startswith("(") else ""
        after = rest[(rest.find("(") + len(params) + 2) if params or rest.lstrip().startswith("()") else 0 :]
        bases = re.match(r"\s*:\s*([^{\n]+)", after)
        body = body_at(after, 0) if re.match(r"\s*(:[^{\n]+)?\s*\{", after) else ""
        methods = [x[1] for x in re.finditer(r"\bfun\s+(?:<[^>]*>\s*)?(\w+)\s*\(", body)]
        classes.append({"name": m[3], "bases": [re.sub(r"\(.*", "", b) for b in split_top(bases[1])] if bases else [], "methods": methods, "decorators": [w for w in words if w.startswith("@")], "docstring": None})
        kind = "sealed" if "sealed" in words else "data" if "data" in words else "enum" if "enum" in words else "interface" if m[2] == "interface" else None
        if kind:
            fields = [{"name": f[1], "type": f[2].strip(), "optional": f[2].strip().endswith("?") or f[3] is not None} for f in (re.match(r"(?:@\w+\s+)*(?:(?:private|override|internal)\s+)*(?:val|var)\s+(\w+)\s*:\s*([^=]+)(=.*)?", p, re.S) for p in split_top(params)) if f]
            contracts.append({"name": m[3], "contract_type": kind, "fields": fields})
    functions = []
    for m in re.finditer(r"^((?:@\w+(?:\([^)]*\))?\s+|(?:suspend|public|private|internal|inline|override)\s+)*)fun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?(\w+)\s*\(", code, re.M):
        params = body_at(code, m.end() - 1, "()")
        returns = re.match(r"\s*:\s*([^={\n]+)", code[m.end() + len(params) + 1 :])
        functions.append({"name": m[2], "parameters": split_top(params), "return_type": returns[1].strip() if returns else None, "is_async": "suspend" in m[1], "decorators": re.findall(r"@\w+(?:\([^)]*\))?", m[1]), "docstring": None, "triggers": []})
    triggers = []
    for m in re.finditer(r"@(Get|Post|Put|Delete|Patch|Request)Mapping(?:\(([^)]*)\))?", code):
        inside = m[2] or ""
        route = re.search(r"[\"']([^\"']+)[\"']", inside)
        method = m[1].upper() if m[1] != "Request" else next((v for v in ("GET", "POST", "PUT", "DELETE") if v in inside.upper()), "GET")
        triggers.append(trigger("http", method, route[1] if route else "/"))
    triggers += [trigger("http", m[1].upper(), m[2]) for m in re.finditer(rf"(?<![.\w])({'|'.join(HTTP_METHODS)})\(\s*\"([^\"]*)\"\s*\)\s*\{{", code)]
    if functions:
        functions[0]["triggers"] += triggers
    entry = None
    if re.search(r"\bfun\s+main\s*\(", code):
        entry = "main"
    elif ("activity" in name or "fragment" in name) and re.search(r"class\s+\w+[^{]*:[^{]*(activity|fragment)", code, re.I):
        entry = "android_component"
    elif any(x in source.lower() for x in ("routing", "route(", "@getmapping", "@postmapping", "@controller")):
        entry = "api_route"
    return {"imports": imports, "exports": exports, "classes": classes, "functions": functions, "contracts": contracts, "entry_point_type": entry, "is_barrel": False}
