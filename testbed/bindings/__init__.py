from testbed.bindings import timeline  # noqa: F401
from testbed.bindings import intervals  # noqa: F401
from testbed.bindings import scoring  # noqa: F401
from testbed.bindings import diagnostics  # noqa: F401
from testbed.bindings import documents  # noqa: F401
from testbed.bindings import modelling  # noqa: F401
from testbed.bindings import files  # noqa: F401
