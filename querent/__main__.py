"""python -m querent list | run NAME SF_DIR [ROWS]"""

import sys

from pyspark.sql import SparkSession

from querent import registry


def main(args: list[str]) -> int:
    found = registry.queries()
    if args[:1] == ["list"]:
        print("\n".join(sorted(found)))
        return 0
    if args[:1] == ["run"] and len(args) >= 3 and args[1] in found:
        spark = SparkSession.builder.appName("querent").getOrCreate()
        found[args[1]](spark, args[2]).show(int(args[3]) if len(args) > 3 else 20, truncate=False)
        return 0
    print(__doc__)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
