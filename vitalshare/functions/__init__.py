from vitalshare.functions.nullsafe import *  # noqa: F401,F403
