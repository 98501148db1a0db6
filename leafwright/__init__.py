"""Document corpus audit on Spark."""

from leafwright.plans.pdf import audit_pdf
from leafwright.plans.workflow import audit, batch, compare, plan, remediate, run, verify_evidence

__all__ = ["audit", "audit_pdf", "batch", "compare", "plan", "remediate", "run", "verify_evidence"]
