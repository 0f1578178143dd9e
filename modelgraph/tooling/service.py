"""Editor service: JSON messages over standard input and output, as editors speak
them (Language Server Protocol)."""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable
from typing import IO, Any

from ..errors import ModelError
from ..functions import CATALOG
from ..plans import Project
from ..syntax import read_module
from ..syntax.printer import module as printed

_WORD = re.compile(r"\w+")
_DECLARED = re.compile(r"(?<!-> )\b(?:source|model|contract|domain|fn|pipeline)\s+(\w+)")
KEYWORDS = "source contract domain model test fn pipeline import from join_left join_inner join_semi join_anti on expect filter where let select derive group aggregate sort take union intersect except dedup expand partition_by freshness incremental".split()


class Service:
    """Answers to the messages of one editor; ``texts`` holds the open files."""

    def __init__(self) -> None:
        self.texts: dict[str, str] = {}
        self.closing = False
        self.methods: dict[str, Callable[[dict], Any]] = {
            "initialize": self.initialize, "shutdown": self.shutdown, "textDocument/hover": self.hover, "textDocument/completion": self.completion,
            "textDocument/definition": self.definition, "textDocument/formatting": self.formatting, "textDocument/documentSymbol": self.symbols,
        }

    def handle(self, message: dict) -> list[dict]:
        """The messages to send back."""
        method, params = message.get("method", ""), message.get("params") or {}
        if method in ("textDocument/didOpen", "textDocument/didChange"):
            document = params["textDocument"]
            self.texts[document["uri"]] = document["text"] if "text" in document else params["contentChanges"][-1]["text"]
            return [self.diagnostics(document["uri"])]
        if method == "textDocument/didClose":
            self.texts.pop(params["textDocument"]["uri"], None)
            return []
        if "id" not in message:
            return []
        if method not in self.methods:
            return [{"jsonrpc": "2.0", "id": message["id"], "error": {"code": -32601, "message": f"unknown method {method}"}}]
        return [{"jsonrpc": "2.0", "id": message["id"], "result": self.methods[method](params)}]

    # -- answers
    def initialize(self, params: dict) -> dict:
        return {"capabilities": {"textDocumentSync": 1, "hoverProvider": True, "completionProvider": {"triggerCharacters": ["."]}, "definitionProvider": True, "documentFormattingProvider": True, "documentSymbolProvider": True}}

    def shutdown(self, params: dict) -> None:
        self.closing = True

    def diagnostics(self, uri: str) -> dict:
        found = []
        try:
            Project.from_text(self.texts[uri]).check()
        except ModelError as e:
            line = max(0, (e.line or 1) - 1)
            found = [{"range": {"start": {"line": line, "character": 0}, "end": {"line": line, "character": 999}}, "severity": 1, "code": e.code, "message": e.message}]
        return {"jsonrpc": "2.0", "method": "textDocument/publishDiagnostics", "params": {"uri": uri, "diagnostics": found}}

    def _project(self, uri: str) -> Project | None:
        try:
            project = Project.from_text(self.texts.get(uri, ""))
            project.check()
            return project
        except ModelError:
            return None

    def _word(self, params: dict) -> str:
        lines = self.texts.get(params["textDocument"]["uri"], "").splitlines()
        at = params["position"]
        line = lines[at["line"]] if at["line"] < len(lines) else ""
        return next((m[0] for m in _WORD.finditer(line) if m.start() <= at["character"] <= m.end()), "")

    def hover(self, params: dict) -> dict | None:
        word, project = self._word(params), self._project(params["textDocument"]["uri"])
        if word in CATALOG:
            fn = CATALOG[word]
            text = f"{word}({', '.join(fn.kinds)}{', ...' if fn.most is None else ''})" + (f": {fn.doc}" if fn.doc else "")
        elif project and (word in project.compiled or word in project.sources):
            columns = project.compiled[word].schema.values() if word in project.compiled else project.sources[word].columns
            text = "\n".join(f"{c.name}: {c.type}{'' if c.nullable else ' nonnull'}" for c in columns)
        else:
            return None
        return {"contents": {"kind": "plaintext", "value": text}}

    def completion(self, params: dict) -> list[dict]:
        uri = params["textDocument"]["uri"]
        names = [(k, 14) for k in KEYWORDS] + [(f, 3) for f in CATALOG] + [(n, 7) for n in _DECLARED.findall(self.texts.get(uri, ""))]
        project = self._project(uri)
        if project:
            names += [(c.name, 5) for s in project.sources.values() for c in s.columns] + [(c, 5) for m in project.compiled.values() for c in m.schema]
        return [{"label": label, "kind": kind} for label, kind in dict.fromkeys(names)]

    def _places(self, uri: str) -> list[tuple[str, dict]]:
        out = []
        for n, line in enumerate(self.texts.get(uri, "").splitlines()):
            for m in _DECLARED.finditer(line):
                out.append((m[1], {"start": {"line": n, "character": m.start(1)}, "end": {"line": n, "character": m.end(1)}}))
        return out

    def definition(self, params: dict) -> dict | None:
        uri, word = params["textDocument"]["uri"], self._word(params)
        return next(({"uri": uri, "range": r} for name, r in self._places(uri) if name == word), None)

    def symbols(self, params: dict) -> list[dict]:
        return [{"name": name, "kind": 5, "range": r, "selectionRange": r} for name, r in self._places(params["textDocument"]["uri"])]

    def formatting(self, params: dict) -> list[dict]:
        text = self.texts.get(params["textDocument"]["uri"], "")
        try:
            new = printed(read_module(text))
        except ModelError:
            return []
        return [] if new == text else [{"range": {"start": {"line": 0, "character": 0}, "end": {"line": text.count("\n") + 1, "character": 0}}, "newText": new}]


def serve(source: IO[bytes] | None = None, target: IO[bytes] | None = None) -> int:
    """Read messages until the editor says exit."""
    source, target = source or sys.stdin.buffer, target or sys.stdout.buffer
    service = Service()
    while True:
        length = 0
        while (line := source.readline()) not in (b"\r\n", b"\n"):
            if not line:
                return 0 if service.closing else 1
            if line.lower().startswith(b"content-length:"):
                length = int(line.split(b":")[1])
        message = json.loads(source.read(length))
        if message.get("method") == "exit":
            return 0 if service.closing else 1
        for answer in service.handle(message):
            body = json.dumps(answer).encode()
            target.write(b"Content-Length: %d\r\n\r\n" % len(body) + body)
            target.flush()
