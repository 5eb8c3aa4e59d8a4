"""python -m twinsieve.cli PANELS OUT [--preset NAME | --config FILE] [--similarity X] [--hamming N]: a run over a table of panels.

Only options that are given change the preset or the file.
"""

from __future__ import annotations

import argparse
import time

from .config import Config, preset
from .plans.engine import Engine
from .session import session
from .sources.files import write_metadata


def main(argv: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("panels")
    a.add_argument("out")
    a.add_argument("--preset")
    a.add_argument("--config")
    a.add_argument("--similarity", type=float)
    a.add_argument("--hamming", type=int)
    o = a.parse_args(argv)
    config = preset(o.preset) if o.preset else Config()
    if o.config:
        with open(o.config, encoding="utf-8") as f:
            config = Config.from_json(f.read())
    given = {k: v for k, v in (("similarity", o.similarity), ("hamming", o.hamming)) if v is not None}
    config = config.with_values(pairing=given) if given else config
    spark, began = session(), time.time()
    result = Engine(spark, config).run(spark.read.parquet(o.panels))
    result.save(f"{o.out}/report")
    write_metadata(spark, f"{o.out}/metadata", config.to_json(), {r.tier: r.n for r in result.counts().collect()}, time.time() - began)


if __name__ == "__main__":
    main()
