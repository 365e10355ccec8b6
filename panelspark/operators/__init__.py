"""DataFrame -> DataFrame operators on panels, sheets and shapes.

Column names are arguments everywhere (``entity=``, ``category=``, ``period=``,
``total=``), so the same code serves any panel.
"""
