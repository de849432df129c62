"""What is normal for an account."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of account whose balance normally lies on the other side than their root's.
CONTRA = ["accumulated_depreciation", "drawings"]


def normal_balance(root: Column, account_type: Column, name: Column | None = None) -> Column:
    """debit or credit: assets and expenses are debit, all others credit; contra accounts the other way round."""
    debit = root.isin("asset", "expense")
    contra = F.coalesce(account_type.isin(CONTRA), F.lit(False))
    if name is not None:
        contra = contra | F.coalesce(F.lower(name).isin(CONTRA), F.lit(False))
    return F.when(root.isNotNull(), F.when(debit != contra, "debit").otherwise("credit"))
