"""python -m querl [-i] [SCRIPT...]: runs scripts, then reads statements until q or exit.

-i reads statements after scripts, as is also done without it. Serving clients is Spark Connect's work.
"""

from __future__ import annotations

import os
import sys

from querl import session
from querl.engine import Engine
from querl.errors import EngineError

STARTUP = "startup.sql"


def main(arguments: list[str]) -> int:
    if {"-h", "--help"} & {*arguments}:
        print(__doc__)
        return 0
    unknown = [a for a in arguments if a.startswith("-") and a != "-i"]
    if unknown:
        print(f"error: unknown option {unknown[0]}", file=sys.stderr)
        return 2
    arguments = [a for a in arguments if a != "-i"]
    engine = Engine(session.create())
    try:
        for path in [STARTUP] * os.path.exists(STARTUP) + arguments:
            print(engine.run_file(path).text())
    except EngineError as e:
        print(f"error: {e}")
        return 1
    while True:
        try:
            line = input("querl> ").strip()
        except EOFError:
            return 0
        if line in ("q", "exit"):
            return 0
        try:
            for result in engine.run_script(line):
                print(result.text())
        except EngineError as e:
            print(f"error: {e}")


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
