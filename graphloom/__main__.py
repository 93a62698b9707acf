import sys

from graphloom.api import main

sys.exit(main())
