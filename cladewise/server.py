"""A small HTTP front: ``GET /``, ``POST /maketree``, and ``POST /sendToMicroReact``, which answers with what a map service takes and sends nothing itself."""

from __future__ import annotations

import csv
import io
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs

from pyspark.sql import SparkSession

from cladewise.backend import backend
from cladewise.sources import profile_files, sinks, trees

#: Form fields that reach the backend, and how their text is read.
FIELDS = {
    "profile": str, "method": str, "matrix_type": str, "heuristic": str, "handle_missing": str, "block_penalty": float, "n_proc": int,
    "branch_recraft": lambda v: v.lower() in ("1", "true", "yes"), "checkEnv": lambda v: v.lower() in ("1", "true", "yes"), "wgMLST": lambda v: v.lower() in ("1", "true", "yes"),
}


def make_tree(spark: SparkSession, form: dict[str, str]) -> tuple[int, str]:
    """Status and text: 204 without a profile, 500 where it fails. Each call has its own options. A profile is taken as text, never as a path."""
    if not form.get("profile", "").strip():
        return 204, ""
    try:
        options = {k: FIELDS[k](v) for k, v in form.items() if k in FIELDS and v != ""}
        options["profile"] = options["profile"].rstrip("\n") + "\n"
        return 200, backend(spark, **options)
    except Exception as error:
        return 500, str(error).split("\n")[0]


def share(spark: SparkSession, form: dict[str, str]) -> tuple[int, str]:
    """Status and text: the JSON of ``tree``, ``data`` (CSV) and ``name``, from a tree's text, metadata separated by tabs, and colours by column and value; 500 where it fails."""
    try:
        nodes = trees.read_tree(spark, form["tree"])
        rows = profile_files.read_metadata(spark, form["metadata"].rstrip("\n") + "\n", "\t")
        newick, table = sinks.share_payload(nodes, rows, json.loads(form.get("colors") or "{}"))
        out = io.StringIO()
        writer = csv.writer(out)
        writer.writerow(table.columns)
        writer.writerows(table.orderBy(table.columns[0]).toLocalIterator())
        return 200, json.dumps({"tree": newick, "data": out.getvalue(), "name": form.get("name", "")})
    except Exception as error:
        return 500, str(error).split("\n")[0]


def serve(spark: SparkSession, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that is ready for ``serve_forever()``."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, text: str) -> None:
            data = text.encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/plain; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):  # noqa: N802
            status = {"/": 200, "/maketree": 405, "/sendToMicroReact": 405}.get(self.path.split("?")[0], 404)
            self._send(status, "POST a profile to /maketree" if status == 200 else "")

        def do_POST(self):  # noqa: N802
            answer = {"/maketree": make_tree, "/sendToMicroReact": share}.get(self.path.split("?")[0])
            if answer is None:
                return self._send(404, "")
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
            return self._send(*answer(spark, {k: v[-1] for k, v in parse_qs(body, keep_blank_values=True).items()}))

        def log_message(self, *args):
            """Quiet."""

    return ThreadingHTTPServer((host, port), Handler)
