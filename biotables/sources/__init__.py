from biotables.sources.sinks import *  # noqa: F401,F403
from biotables.sources.text import *  # noqa: F401,F403
