"""``python -m groundlake JOB ...``; see jobs."""

import sys

from groundlake.jobs import main

sys.exit(main(sys.argv[1:]))
