"""python -m quillstore serve | version | help"""

from __future__ import annotations

import argparse
import ipaddress
import os
import sys

from . import __version__

TOKEN_VARIABLE = "QUILLSTORE_TOKEN"


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quillstore", description="Collections of JSON documents on Spark.")
    commands = parser.add_subparsers(dest="command")
    serve = commands.add_parser("serve", help="answer HTTP requests")
    serve.add_argument("--dir", default="./data", help="where the data is (./data)")
    serve.add_argument("--bind", default="127.0.0.1", help="where to listen (127.0.0.1)")
    serve.add_argument("--port", type=int, default=8787)
    commands.add_parser("version")
    commands.add_parser("help")
    return parser


def _loopback(host: str) -> bool:
    try:
        return ipaddress.ip_address(host).is_loopback
    except ValueError:
        return host == "localhost"


def main(arguments: list[str] | None = None) -> int:
    parser = _parser()
    options = parser.parse_args(arguments)
    if options.command == "version":
        print(__version__)
    elif options.command == "serve":
        return _serve(options)
    else:
        parser.print_help()
    return 0


def _serve(options) -> int:
    token = os.environ.get(TOKEN_VARIABLE) or None
    if token is None and not _loopback(options.bind):
        print(f"{options.bind} isn't loopback: set {TOKEN_VARIABLE}", file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    from .server import Server
    from .store import Store

    spark = SparkSession.builder.appName("quillstore").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    with Store(spark, os.path.abspath(options.dir)) as store, Server((options.bind, options.port), store, token) as server:
        host = f"[{options.bind}]" if ":" in options.bind else options.bind
        print(f"listening on http://{host}:{server.server_address[1]}")
        try:
            server.serve_forever()
        except KeyboardInterrupt:
            pass
    return 0


if __name__ == "__main__":
    sys.exit(main())
