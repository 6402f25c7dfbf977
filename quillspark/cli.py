"""Command line: ``index``, ``search``, ``open``, ``settings``."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from quillspark.operators import embed as E
from quillspark.operators import search as S
from quillspark.plans.index import cycle
from quillspark.plans.store import Lock, Store
from quillspark.session import session
from quillspark.settings import SOURCES, active
from quillspark.sources.mail import open_target
from quillspark.streaming.poll import poll


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillspark", description=__doc__)
    p.add_argument("--home", default=str(Path.home() / ".quillspark"))
    sub = p.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index")
    index.add_argument("--store", action="append", default=[], metavar="SOURCE=PATH")
    index.add_argument("--mailing-lists", action="store_true")
    index.add_argument("--once", action="store_true")
    search = sub.add_parser("search")
    search.add_argument("query")
    search.add_argument("--limit", type=int)
    search.add_argument("--preview", type=int)
    search.add_argument("--format", choices=("text", "json"))
    search.add_argument("--open", type=int, metavar="N", help="also print where hit N opens")
    opened = sub.add_parser("open")
    opened.add_argument("message_id")
    sub.add_parser("settings")
    a = p.parse_args(argv)

    settings = active(Path(a.home) / "settings.toml")
    preference = settings.clients or list(SOURCES)
    if a.command == "settings":
        settings.save(Path(a.home) / "settings.toml")
        print(Path(a.home) / "settings.toml")
        return 0
    spark = session("local[*]", spark__ui__enabled="false", spark__log__level="ERROR")
    store, encoder = Store(spark, f"{a.home}/store"), E.HashingEncoder()
    if a.command == "index":
        stores = dict(x.split("=", 1) for x in a.store) or ({"plain-mbox": settings.root} if settings.root else {})
        with Lock(Path(a.home) / "lock"):
            wanted = {k: stores[k] for k in preference if k in stores}
            if a.once:
                print(cycle(spark, store, wanted, encoder, a.mailing_lists).report())
            else:
                poll(spark, store, wanted, encoder, f"{a.home}/stream", settings.index.poll_seconds, a.mailing_lists, lambda done: print(done.report(), flush=True)).awaitTermination()
            return 0
    if a.command == "open":
        return _show(S.open_rows(store.look_up("email_sources", [a.message_id]), a.message_id, preference).collect(), settings.webmail)
    limit, preview = a.limit or settings.search.limit, a.preview or settings.search.preview
    ranked = S.search(store.read("email_vectors"), store.read("emails"), E.embed_query(encoder, a.query), limit)
    kind = a.format or settings.search.format
    print((S.to_json(S.results(ranked, preview)) if kind == "json" else S.to_text(ranked, preview)).first()[0])
    if a.open is not None:
        hit = S.nth(ranked, a.open).select("message_id").first()
        if hit is None:
            print(f"no result {a.open}", file=sys.stderr)
            return 1
        return _show(S.open_rows(store.look_up("email_sources", [hit.message_id]), hit.message_id, preference).collect(), settings.webmail)
    return 0


def _show(rows: list, webmail: bool) -> int:
    for r in rows:
        print(open_target(r, webmail))
    return 0 if rows else 1


if __name__ == "__main__":
    sys.exit(main())
