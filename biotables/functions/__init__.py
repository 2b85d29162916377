from biotables.functions.columns import *  # noqa: F401,F403
from biotables.functions.parsers import *  # noqa: F401,F403
