from .expr import Arg, Const, Expr, ExpressionFunction, arg, const
from .logic import is_false, is_true, is_unknown, weak_and, weak_not, weak_or

__all__ = ["Arg", "Const", "Expr", "ExpressionFunction", "arg", "const", "is_false", "is_true", "is_unknown", "weak_and", "weak_not", "weak_or"]
