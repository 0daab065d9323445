from quantloom.functions.expressions import double_array, elements, finite, full_window, ratio, total

__all__ = ["double_array", "elements", "finite", "full_window", "ratio", "total"]
