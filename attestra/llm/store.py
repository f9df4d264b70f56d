"""The library's shared folder for intermediate results, under the names that the operators here use."""

from attestra.plans.store import KEPT, checkpointed, released, removed, shared_folder, written

__all__ = ["KEPT", "checkpointed", "released", "removed", "shared_folder", "written"]
